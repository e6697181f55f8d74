"""A run-length index of a text: its Burrows-Wheeler transform by runs, with samples at run ends.

Suffixes are sorted once to build it; what is kept are the runs of the transform and, at each
run's start, where the suffix and the one before it (the end of the run above) begin. Between
samples both move along the text in step, so streaming over the text gives for every place
the place of its neighbour in suffix order and how long the two match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols below 512, by doubling over packed groups of seven."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(U64), np.zeros(7, U64)])
    key = np.zeros(n, U64)
    for k in range(7):
        key = (key << U64(9)) | padded[k: k + n]
    depth = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or depth >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - depth)] = rank[depth:] + 1
        key = rank.astype(U64) * U64(n + 1) + after.astype(U64)
        depth *= 2


@dataclass
class RunIndex:
    """Runs of the transform and the samples at their starts."""

    heads: np.ndarray  # symbol of each run
    lengths: np.ndarray  # its length
    place: np.ndarray  # where the first suffix of the run begins
    above: np.ndarray  # where the suffix before it begins: the sampled end of the run above; -1 for the first run


def build(symbols: np.ndarray) -> RunIndex:
    order = sorted_suffixes(symbols)
    last = symbols[order - 1]  # the transform; the symbol before place 0 is the last one
    starts = np.concatenate([[True], last[1:] != last[:-1]])
    # a run ends where the text begins too, so that every stretch between samples is one move
    zero = int(np.flatnonzero(order == 0)[0])
    starts[zero] = True
    if zero + 1 < len(starts):
        starts[zero + 1] = True
    at = np.flatnonzero(starts)
    above = np.where(at > 0, order[at - 1], -1)
    return RunIndex(last[at], np.diff(np.append(at, len(order))), order[at], above)


def match_lengths(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the text matches from a and from b; 0 where b is negative.

    At samples of an index these lengths add up to n log n symbols at most.
    """
    n, step = len(symbols), 8
    padded = np.concatenate([symbols, np.full(step, 511, symbols.dtype)])
    words = np.lib.stride_tricks.sliding_window_view(padded, step)
    found = np.zeros(len(a), np.int64)
    active = np.flatnonzero(b >= 0)
    while len(active):
        x, y = a[active] + found[active], b[active] + found[active]
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        same = words[x] == words[y]
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        found[active] += run
        active = active[run == step]
    return np.minimum(found, np.minimum(n - a, n - np.maximum(b, 0)))


def neighbours(index: RunIndex, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the text: the suffix before it in order, and how far the two match.

    Streams over the text from sample to sample: one step on, both places move by one and the
    match is one shorter, until the next sample says otherwise.
    """
    n = len(symbols)
    matched = match_lengths(symbols, index.place, index.above)
    at = np.full(n, -1, np.int64)
    at[index.place] = np.arange(len(index.place))
    sample = np.maximum.accumulate(np.where(at >= 0, np.arange(n), 0))
    own = at[sample]
    ahead = np.arange(n) - sample
    length = np.maximum(matched[own] - ahead, 0)
    before = np.where(index.above[own] >= 0, index.above[own] + ahead, -1)
    return before, np.where(before >= 0, length, 0)


def repeated(symbols: np.ndarray, least: int, end_of: np.ndarray) -> np.ndarray:
    """Places where a string of `least` symbols starts that also starts at a smaller place.

    `end_of` gives for each place the end of its part of the text; matches do not cross it.
    """
    n = len(symbols)
    index = build(symbols)
    before, length = neighbours(index, symbols)
    room = end_of - np.arange(n)
    linked = (before >= 0) & (length >= least) & (room >= least)
    linked &= np.where(before >= 0, end_of[before] - before, 0) >= least
    # equal strings stand together in suffix order: follow the links to the head of each chain
    head = np.where(linked, before, np.arange(n))
    while True:
        further = head[head]
        if np.array_equal(further, head):
            break
        head = further
    smallest = np.full(n, n, np.int64)
    np.minimum.at(smallest, head, np.arange(n))
    return (room >= least) & (smallest[head] < np.arange(n))
