"""Repeated byte strings of a fixed length across documents, with a run-length index.

A string of `length` bytes is a repeat if it also starts earlier: in a document with a smaller
id, or in the same one before. Every byte that lies in a repeat is marked. Indexing all text
at once would make one index of the corpus; instead, text is first cut to what can repeat:

1. Every string of `length` bytes has an anchor: its 32-byte piece with the smallest hash. Equal
   strings have equal anchors at the same place in them. The strings that share one anchor
   in a text form a stretch of at most 2*length bytes. Anchors (3 % of the bytes) are shuffled;
   an anchor that occurs once in the corpus proves its strings unique.
2. Stretches with the same anchor and the same bytes are copies: all but the first are marked.
   Copies inside one batch of rows are found before the shuffle, so that a passage in a third
   of all documents is a row per batch, not per document.
3. Anchors with several different stretches are decided by the run-length index: the first
   stretch of each kind is put into blocks of text, an index of each block is built (runs of
   the Burrows-Wheeler transform, samples at run ends), match lengths are streamed from
   it, and places that match an earlier one over `length` bytes are marked.
4. Marks are gathered by document and the bytes are cut out.

Anchors and stretches are compared by 64-bit hashes; step 3 compares bytes.

Defined results for odd input: NULL text is empty; documents shorter than `length` stay as
they are; a NULL doc_id comes after all others; rows with the same doc_id and text are one
document, judged alike; rows with the same doc_id but other text are ordered by start, then
by a hash of their text; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import runindex
from docketry.llm.tables import at_most, settle
from docketry.llm.textbytes import LETTER, U64, mixed, powers, slices

PIECE = 32
LAST = (1 << 63) - 1  # stands for a NULL doc_id: after all others
BLOCK_BYTES = 1_000_000
#: anchors that may travel with the tasks (8 bytes each); more are joined
CARRIED_ANCHORS = 2_000_000
MARK = 0


@dataclass
class Stretches:
    """The stretches of some texts, as arrays; `text` numbers the texts."""

    anchor: np.ndarray  # hash of the anchor's bytes
    content: np.ndarray  # hash of the stretch's bytes; never MARK
    text: np.ndarray
    at: np.ndarray  # where the anchor starts
    low: np.ndarray  # first byte of the stretch
    high: np.ndarray  # behind its last byte


def stretches(texts: list[bytes], length: int) -> tuple[Stretches, np.ndarray, np.ndarray]:
    """All stretches of some texts, the joined bytes, and where each text starts in them."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    n = len(joined)
    empty = np.zeros(0, np.int64)
    if n < length:
        return Stretches(empty, empty, empty, empty, empty, empty), joined, begins
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(LETTER[joined] * up[:n], out=sums[1:])
        pieces = mixed((sums[PIECE:] - sums[:-PIECE]) * down[: n - PIECE + 1])
        width = length - PIECE + 1  # pieces in a string
        bits = U64(int(n).bit_length())
        least = (pieces >> bits << bits) | np.arange(len(pieces), dtype=U64)  # equal hashes: the first one
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        owner = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)
        start = np.arange(len(owner))
        text = np.searchsorted(ends, start, "right")
        inside = start + length <= ends[np.minimum(text, len(ends) - 1)]
        start, owner, text = start[inside], owner[inside], text[inside]
        if not len(start):
            return Stretches(empty, empty, empty, empty, empty, empty), joined, begins
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
        low = start[new]
        high = np.append(start[np.flatnonzero(new)[1:] - 1], start[-1]) + length
        owner, text = owner[new], text[new]
        content = mixed((sums[high] - sums[low]) * down[low] + mixed((owner - low).astype(U64) * U64(1 << 20) + (high - low).astype(U64)))
        content[content == MARK] = U64(1)
        base = begins[text]
        return Stretches(pieces[owner].view(np.int64), content.view(np.int64), text, owner - base, low - base, high - base), joined, begins


ROW = "anchor long, content long, doc long, at int, same_doc long, low int, high int"
NAMES = [f.split()[0] for f in ROW.split(", ")]


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same_doc"), "text")


def _columns(batch: pa.RecordBatch, length: int, with_bytes: set | None = None, wanted: np.ndarray | None = None):
    """The stretches of a batch as columns in the order of NAMES, and their bytes if asked for."""
    doc_ids, same = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    parts: list[list[np.ndarray]] = []
    raw: list[bytes] = []
    for at, texts in slices(batch.column(2)):
        s, joined, begins = stretches(texts, length)
        keep = np.arange(len(s.anchor))
        if wanted is not None and len(keep):
            found = np.searchsorted(wanted, s.anchor)
            found[found == len(wanted)] = 0
            keep = np.flatnonzero(wanted[found] == s.anchor)
        rows = s.text[keep] + at
        parts.append([s.anchor[keep], s.content[keep], doc_ids[rows], s.at[keep], same[rows], s.low[keep], s.high[keep]])
        if with_bytes is not None:
            whole = joined.tobytes()
            for k in keep:
                base = int(begins[s.text[k]])
                raw.append(whole[base + int(s.low[k]): base + int(s.high[k])])
    if not parts:
        return [np.zeros(0, np.int64)] * 7, raw
    return [np.concatenate(c) for c in zip(*parts, strict=True)], raw


def _copies(c: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by anchor, content, document and place; which rows open a kind, and which are later copies."""
    order = np.lexsort((c[4], c[3], c[2], c[1], c[0]))
    anchor, content = c[0][order], c[1][order]
    opens = np.ones(len(order), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    leader = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    later = (c[2][order] != c[2][leader]) | (c[3][order] != c[3][leader]) | (c[4][order] != c[4][leader])
    return order, opens, later


def _out(columns: list[np.ndarray], extra: list | None = None, names: list[str] = NAMES) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    arrays = [pa.array(c.astype(np.int32) if t == pa.int32() else c, t) for c, t in zip(columns, kinds, strict=True)]
    if extra is not None:
        arrays.append(pa.array(extra, pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """A row per stretch; later copies inside a batch come as marks (content MARK) at once."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, _ = _columns(batch, length)
            order, opens, later = _copies(c)
            with np.errstate(over="ignore"):
                marks = order[later]
                spread = mixed(c[2][marks].view(U64) + c[5][marks].astype(U64)).view(np.int64)  # any key: marks only pass through
            first = order[opens]
            yield _out([np.concatenate([x, y]) for x, y in zip(
                [v[first] for v in c], [spread, np.full(len(marks), MARK), *(v[marks] for v in c[2:])], strict=True)])

    return docs.mapInArrow(make, ROW)


DECIDED = "kind int, doc long, same_doc long, low int, high int, anchor long"


def decided(rows: DataFrame) -> DataFrame:
    """kind 0: a marked stretch (doc, same_doc, low, high); kind 1: an anchor with several kinds of stretches."""
    sorted_ = rows.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "at", "same_doc")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 7  # the first stretch of each kind of the last anchor
        for batch in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            passing = c[1] == MARK
            marks = [x[passing] for x in c]
            c = [np.concatenate([h, x[~passing]]) for h, x in zip(held, c, strict=True)]
            fresh = np.arange(len(c[0])) >= len(held[0])
            order, opens, later = _copies(c)
            out = order[later & fresh[order]]
            firsts = order[opens]
            anchor = c[0][firsts]
            several = anchor[1:][anchor[1:] == anchor[:-1]]
            open_ = np.unique(several)
            if len(anchor):
                last = firsts[anchor == anchor[-1]]
                held = [x[last] for x in c]
            n, m = len(marks[0]) + len(out), len(open_)
            filler = np.zeros(m, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([0, 1], [n, m]), pa.int32()),
                *(pa.array(np.concatenate([marks[k], c[k][out], filler]).astype(np.int64), pa.int64()).cast(t)
                  for k, t in ((2, pa.int64()), (4, pa.int64()), (5, pa.int32()), (6, pa.int32()))),
                pa.array(np.concatenate([np.zeros(n, np.int64), open_]), pa.int64())],
                names=["kind", "doc", "same_doc", "low", "high", "anchor"])

    return sorted_.mapInArrow(sift, DECIDED)


def open_stretches(docs: DataFrame, open_anchors: DataFrame, length: int) -> DataFrame:
    """The stretches, with their bytes, of the anchors that need the index."""
    few = at_most(open_anchors, CARRIED_ANCHORS)
    wanted = np.sort(open_anchors.toArrow().column("anchor").to_numpy()) if few else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None and not len(wanted):
                continue
            c, raw = _columns(batch, length, set(), wanted)
            order, opens, _ = _copies(c)
            first = order[opens]  # later copies have been marked
            yield _out([v[first] for v in c], [raw[k] for k in first], [*NAMES, "bytes"])

    rows = docs.mapInArrow(make, ROW + ", bytes binary")
    return rows if few else rows.join(open_anchors, "anchor", "left_semi")


MARKED = "doc long, same_doc long, low int, high int"


def indexed(rows: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The marks that the run-length index gives: strings that start earlier in another stretch of their anchor."""
    sorted_ = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "at", "same_doc")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        kinds: set[int] = set()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if row[0] != last:
                    last, kinds = row[0], set()
                    if size >= block_bytes:
                        yield block(held)
                        held, size = [], 0
                if row[1] in kinds:  # a later copy of a stretch
                    continue
                kinds.add(row[1])
                held.append(row)
                size += len(row[7]) + 1
        if held:
            yield block(held)

    def block(rows_: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[7]) for r in rows_])
        ends = np.cumsum(sizes + 1) - 1  # separators stand there
        begins = ends - sizes
        symbols = np.frombuffer(b"\0".join(r[7] for r in rows_) + b"\0", np.uint8).astype(np.uint16) + 1
        symbols[ends] = 0
        found = runindex.repeated(symbols, length, np.repeat(ends, sizes + 1))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]])))
        first, behind = edge[0::2], edge[1::2]  # runs of places; none crosses a separator
        row = np.searchsorted(ends, first)
        low = np.array([r[5] for r in rows_], np.int64)[row] - begins[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[2] for r in rows_], np.int64)[row]), pa.array(np.array([r[4] for r in rows_], np.int64)[row]),
             pa.array((low + first).astype(np.int32)), pa.array((low + behind - 1 + length).astype(np.int32))],
            names=["doc", "same_doc", "low", "high"])

    return sorted_.mapInArrow(mark, MARKED)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc, same_doc, low, high: stretches of repeats, overlapping ones not yet put together."""
    ready = prepared(docs)
    first = settle(decided(anchors(ready, length)))
    open_ = settle(first.filter("kind = 1").select("anchor").distinct())
    more = indexed(open_stretches(ready, open_, length), length)
    return first.filter("kind = 0").select("doc", "same_doc", "low", "high").unionByName(more)


def dedup(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept bytes) of every document."""
    ranges = removed_ranges(docs, length).groupBy("doc", "same_doc").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges"))
    both = prepared(docs).join(ranges, ["doc", "same_doc"], "left").select(
        "doc", "text", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, low, high in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()),
                                            batch.column(2), batch.column(3), strict=True):
                raw = text.as_py() or b""
                kept, removed, spans, at = [], 0, 0, 0
                if low.is_valid:
                    a, b = (np.asarray(x.values) for x in (low, high))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    begin, end = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                        kept.append(raw[at:x])
                        removed, spans, at = removed + y - x, spans + 1, y
                kept.append(raw[at:])
                whole = b"".join(kept)
                row = (None if doc == LAST else doc, len(raw), removed, spans, hashlib.sha256(whole).hexdigest())
                out.append((*row, whole) if keep_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 if keep_text else 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    return both.mapInArrow(cut, RESULT + (", kept binary" if keep_text else ""))
