"""Hard negatives: rows of another label that score almost as high as an anchor's positives.

The rows lie in Parquet blocks along a Hilbert curve (`zone_blocks`), each with the range of every
dimension. For an anchor, interval arithmetic over a block's ranges bounds the scores of all its
rows: the sum of each dimension's larger product is the most, of the smaller ones the least. A
block is read only if

- for positives: it has rows of the anchor's label and its most beats the worst positive so far;
- for a positive's window: it has rows of other labels, its bounds meet the window of scores, and
  its most beats the worst negative so far.

Where the most equals the worst so far, the smallest id of the block decides. Blocks are taken
from the most promising one on, so the lists close early; the result is exact whatever is skipped.

Anchors are taken in groups of some dozens, neighbours on the curve together; a group streams
the zones, some thousand at a time, and holds a few blocks. Nothing is shuffled but the rows once,
to sort them, and one row per anchor.

Defined results for odd input: rows with a NULL id, label or vector, or with a NULL or non-finite
component take no part; vectors of different length meet on their common components; a repeated
vec_id is a candidate as often as it stands there and an anchor once (its smallest label and
vector), and no row is a positive of its own id; a positive with a negative score has no
negatives; an empty table gives an empty result; other columns are not looked at. Scores are
64-bit whole numbers: components so large that a score could pass that raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.tables import settle
from docketry.llm.zone_blocks import BLOCK_ROWS, Blocks, grid_of, matrix, placed, write

GROUP = 64  # anchors that look at a block together
MINED = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
         "blocks_read long, blocks long")
NEVER = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): components as floor(scale * x), rows with anything missing left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return embeddings.select("vec_id", label.cast("int").alias("label"), F.when(fine, whole).alias("vector")).dropna()


class Best:
    """The first `n` (score, id) of several lists: higher scores first, ties by smaller id."""

    def __init__(self, lists: int, n: int):
        self.n = n
        self.scores = np.full((lists, n), NEVER, np.int64)
        self.ids = np.full((lists, n), LAST, np.int64)

    def may_gain(self, most: np.ndarray, first_id: int) -> np.ndarray:
        """Lists that a row with at most this score and at least this id could enter."""
        worst, last = self.scores[:, -1], self.ids[:, -1]
        return (most > worst) | ((most == worst) & (first_id < last))

    def offer(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Rows (ids) with their scores for each of the lists, where allowed."""
        worst, last = self.scores[lists, -1][:, None], self.ids[lists, -1][:, None]
        hit, at = np.nonzero(allowed & ((scores > worst) | ((scores == worst) & (ids[None, :] < last))))
        if not len(hit):
            return
        touched = np.unique(hit)
        old = np.repeat(touched, self.n)
        r = np.concatenate([hit, old])
        s = np.concatenate([scores[hit, at], self.scores[lists[touched]].ravel()])
        i = np.concatenate([ids[at], self.ids[lists[touched]].ravel()])
        order = np.lexsort((i, ~s, r))
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < self.n
        self.scores[lists[r[top]], rank[top]] = s[top]
        self.ids[lists[r[top]], rank[top]] = i[top]


class Group:
    """Anchors that are searched for together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, blocks: Blocks, kind: type):
        self.ids, self.labels, self.blocks, self.kind = ids, labels, blocks, kind
        self.vectors = vectors.astype(kind)
        self.up, self.down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        self.read_by = np.zeros(len(ids), np.int64)
        self.n_blocks = 0

    def search(self, best: Best, owner: np.ndarray, wanted, low: np.ndarray, high: np.ndarray, same: bool) -> None:
        """Fill `best`: a list per entry of `owner` (an anchor's number), of scores in [low, high]."""
        self.n_blocks = 0
        for zone in self.blocks.zones():
            self.n_blocks += len(zone["block"])
            lows, highs = zone["low"].astype(self.kind), zone["high"].astype(self.kind)
            most = (self.up @ highs.T + self.down @ lows.T).astype(np.int64)[owner]
            least = (self.up @ lows.T + self.down @ highs.T).astype(np.int64)[owner]
            fits = wanted(zone["low_label"], zone["high_label"])[owner] & (most >= low[:, None]) & (least <= high[:, None])
            most = np.minimum(most, high[:, None])
            # the block that promises most to any list comes first
            promise = np.where(fits, most, NEVER).max(0)
            for b in np.argsort(-promise.astype(float), kind="stable").tolist():
                open_ = fits[:, b] & best.may_gain(most[:, b], int(zone["first_id"][b]))
                if not open_.any():
                    continue
                lists = np.flatnonzero(open_)
                anchors, of = np.unique(owner[lists], return_inverse=True)
                self.read_by[anchors] += 1
                ids, labels, vectors = self.blocks.read(zone["file"][b], zone["block"][b])
                scores = (self.vectors[anchors] @ vectors.astype(self.kind).T).astype(np.int64)[of]
                mine = labels[None, :] == self.labels[owner[lists]][:, None]
                allowed = (mine & (ids[None, :] != self.ids[owner[lists]][:, None])) if same else ~mine
                allowed &= (scores >= low[lists][:, None]) & (scores <= high[lists][:, None])
                best.offer(lists, scores, ids, allowed)

    def mine(self, positives: int, negatives: int, percent: int) -> dict[str, np.ndarray]:
        n = len(self.ids)
        everyone, any_low, any_high = np.arange(n), np.full(n, NEVER), np.full(n, LAST)
        own = Best(n, positives)
        labels = self.labels[:, None]
        self.search(own, everyone, lambda a, b: (labels >= a) & (labels <= b), any_low, any_high, same=True)
        owner, place = np.nonzero((own.scores > NEVER) & (own.scores >= 0))
        high = own.scores[owner, place]
        low = -((-percent * high) // 100)
        near = Best(len(owner), negatives)
        if len(owner):
            self.search(near, owner, lambda a, b: ~((labels == a) & (labels == b)), low, high, same=False)
        w, rank = np.nonzero(near.scores > NEVER)
        return {
            "anchor_id": self.ids[owner[w]], "positive_id": own.ids[owner[w], place[w]], "rank": (rank + 1).astype(np.int32),
            "negative_id": near.ids[w, rank], "positive_score": high[w], "negative_score": near.scores[w, rank],
            "blocks_read": self.read_by[owner[w]], "blocks": np.full(len(w), self.n_blocks)}


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80,
         block_rows: int = BLOCK_ROWS, group: int = GROUP) -> DataFrame:
    """Negatives of every anchor and positive among rows (vec_id, label, vector).

    A window holds the rows of other labels whose score is at least `percent` of the positive's
    score and at most that score. `blocks_read` says how often an anchor's search read a block, for
    positives and negatives together, of `blocks` there are.
    """
    spark = rows.sparkSession
    rows = settle(rows)
    grid = grid_of(rows)
    if not grid.rows:
        return spark.createDataFrame([], MINED)
    width, reach = grid.width, float(np.maximum(np.abs(grid.low), np.abs(grid.high)).max(initial=0.0))
    bound = max(width, 1) * reach * reach * max(percent, 100)
    if bound >= 2.0 ** 62:
        raise ValueError(f"components up to {reach:g} make scores of more than 64 bits")
    kind = np.float64 if bound < 2.0 ** 53 else np.int64
    folder, zones = write(rows, grid, block_rows)
    zone_files = sorted(zones.inputFiles())
    anchors = settle(placed(rows.filter(is_anchor), grid).groupBy("vec_id").agg(
        F.min(F.struct("label", "vector", "place")).alias("one")).select("vec_id", "one.*"))
    parts = max(1, -(-anchors.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, zone_files, width)
        for batch in batches:
            for a in range(0, len(batch), group):
                ids, labels, vectors = (batch.column(k).slice(a, group) for k in range(3))
                found = Group(ids.to_numpy(), labels.to_numpy(), matrix(vectors, width), blocks, kind).mine(
                    positives, negatives, percent)
                yield pa.RecordBatch.from_pydict(found)

    order = ["label", "place", "vec_id"]
    return anchors.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "vec_id", "label", "vector").mapInArrow(run, MINED)
