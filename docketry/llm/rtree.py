"""A packed R-tree over count vectors, for pairs whose sets may overlap enough.

A set's tokens are hashed into groups; the counts per group are its point. Two sets share at
most the sum over groups of the smaller count, and a set shares with anything below a node at
most the sum over groups of the smaller of its count and the node's largest. Pairs and nodes
that fall short of the overlap a similarity needs are cut off. Counts may be cut at a ceiling:
what a set has beyond it is its excess, and two sets share at most the smaller excess more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 24


def needed(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets of these sizes at a Jaccard similarity of percent/100."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def packed(points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Leaves of at most `leaf` rows: cut by size first, then by the coordinates that vary most."""
    todo, leaves, depth = [(rows, 0)], [], 0
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        axis = sizes[rows] if depth % 3 == 0 else points[rows, int(np.argmax(points[rows].var(axis=0)))]
        order = rows[np.argsort(axis, kind="stable")]
        half = len(order) // 2
        todo += [(order[:half], depth + 1), (order[half:], depth + 1)]
    return leaves


class Tree:
    """Leaves and their boxes, and the boxes of groups of leaves above them."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, sizes
        self.excess = sizes - points.sum(axis=1, dtype=np.int64)
        self.leaves = packed(points, sizes, np.arange(len(points)), leaf)
        top = np.array([points[r].max(axis=0) for r in self.leaves])
        least = np.array([sizes[r].min() for r in self.leaves])
        most = np.array([sizes[r].max() for r in self.leaves])
        over = np.array([self.excess[r].max() for r in self.leaves])
        #: from the leaves up: (largest counts, least and largest size, largest excess) of each node; a node has 16 children
        self.levels = [(top, least, most, over)]
        while len(self.levels[-1][0]) > 16:
            top, least, most, over = self.levels[-1]
            cuts = range(0, len(top), 16)
            self.levels.append((
                np.array([top[c: c + 16].max(axis=0) for c in cuts]), np.array([least[c: c + 16].min() for c in cuts]),
                np.array([most[c: c + 16].max() for c in cuts]), np.array([over[c: c + 16].max() for c in cuts])))

    def near_leaves(self, rows: np.ndarray, percent: int) -> np.ndarray:
        """Leaves that may hold a partner for one of the rows."""
        point, excess = self.points[rows].max(axis=0), self.excess[rows].max()
        least, most = self.sizes[rows].min(), self.sizes[rows].max()
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high, over = (x[nodes] for x in self.levels[level])
            bound = np.minimum(top, point).sum(axis=1, dtype=np.int64) + np.minimum(over, excess)
            fits = (bound >= needed(low, least, percent)) & (100 * high >= percent * least) & (100 * most >= percent * low)
            nodes = nodes[fits]
            if level:
                nodes = (nodes[:, None] * 16 + np.arange(16)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        return nodes


def pairs(points: np.ndarray, sizes: np.ndarray, groups: np.ndarray, percent: int, left: np.ndarray | None = None,
          leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different groups that may be similar enough, as two arrays of rows.

    With `left` (a truth value per row) only pairs of a left row with another; else all.
    """
    tree = Tree(points, sizes, leaf)
    if left is None:
        asking = list(enumerate(tree.leaves))
    else:
        asking = [(-1, r) for r in packed(points, sizes, np.flatnonzero(left), leaf)]
    for own, rows in asking:
        for other in tree.near_leaves(rows, percent):
            if left is None and other < own:
                continue
            there = tree.leaves[other]
            if left is not None:
                there = there[~left[there]]
            bound = np.minimum(points[rows][:, None, :], points[there][None, :, :]).sum(axis=2, dtype=np.int64)
            bound += np.minimum(tree.excess[rows][:, None], tree.excess[there][None, :])
            a, b = sizes[rows][:, None], sizes[there][None, :]
            fits = (bound >= needed(a, b, percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
            fits &= groups[rows][:, None] != groups[there][None, :]
            if left is None and other == own:
                fits &= np.arange(len(rows))[:, None] < np.arange(len(there))[None, :]
            i, j = np.nonzero(fits)
            if len(i):
                yield rows[i], there[j]
