"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's text is cut into windows of `window` words (a shorter item is one window). A window
is the sequence of its shingles. A document holds the window only if it holds all of its
shingles, so one of them is enough to find every place worth a look: the rarest, which is
what the prefix of a window in order of rarity comes to when all of it must be there.

1. count, over all documents, how often each shingle of the items occurs;
2. give every window its rarest shingle and the place of that shingle in the window;
3. find those shingles in the documents; the place gives the only possible window start,
   which must lie inside the document with all its words (positional and length bound);
4. compare the words themselves.

The items' side is small by nature; it is split into blocks of BLOCK_WINDOWS windows, and the
documents are read once per block, so what a task holds is bounded for any benchmark.

Defined results for odd input: a NULL or wordless text has no words and no windows; repeated
rows are judged one by one; items with the same id count once; NULL item_ids are left out of
the list of ids but their windows count as hits; empty tables give empty or clean results;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from docketry.llm.tables import settle
from docketry.llm.textbytes import ALPHANUMERIC, Words, slices

BLOCK_WINDOWS = 200_000


@dataclass(frozen=True)
class Sizes:
    """Words per window and per shingle."""

    window: int = 10
    shingle: int = 5


def item_windows(benchmark: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """item_id, words (one string, spaces between), n_words, shingles array<long> of every window."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for at, texts in slices(batch.column(1)):
                words = Words(texts, ALPHANUMERIC)
                hashes, raw = words.hashes(), words.bytes.tobytes()
                for k in range(len(texts)):
                    begin, end = int(words.first[k]), int(words.first[k + 1])
                    size = min(sizes.window, end - begin)
                    if not size:
                        continue
                    part = min(sizes.shingle, size)
                    starts, found = words.shingles(hashes, part)
                    first = np.searchsorted(starts, begin)
                    for w in range(begin, end - size + 1):
                        shingles = found[first + w - begin: first + w - begin + size - part + 1].view(np.int64)
                        text = b" ".join(raw[words.begin[i]: words.end[i]] for i in range(w, w + size))
                        out.append((ids[at + k], text.decode(), size, shingles.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [()] * 4, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())), strict=True)],
                names=["item_id", "words", "n_words", "shingles"])

    return benchmark.select("item_id", "text").mapInArrow(
        cut, "item_id long, words string, n_words int, shingles array<long>")


class Finder:
    """A sorted set of 64-bit values, with a bit per value of their upper bits before the search."""

    def __init__(self, values: np.ndarray, bits: int = 22):
        self.values = np.sort(values)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.values >> self.shift).astype(np.int64)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where `values` has a member of the set."""
        maybe = np.flatnonzero(self.seen[(values >> self.shift).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.values, values[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == values[maybe]]


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """shingle, n: how often the wanted shingles (size -> values) occur in all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {size: Finder(values) for size, values in wanted.items()}
        for batch in batches:
            found = []
            for _, texts in slices(batch.column(0)):
                words = Words(texts, ALPHANUMERIC)
                hashes = words.hashes()
                for size, finder in finders.items():
                    _, values = words.shingles(hashes, size)
                    found.append(values[finder.places(values)])
            values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def with_rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, words, n_words, shingle, place, size: every window with its rarest shingle."""
    one = windows.withColumn("window", F.monotonically_increasing_id())
    each = one.select("window", F.posexplode("shingles").alias("place", "shingle"))
    ranked = each.join(counts, "shingle", "left").groupBy("window").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place")).alias("best"))
    return one.join(ranked, "window").select(
        "item_id", "words", "n_words", F.col("best.shingle").alias("shingle"), F.col("best.place").alias("place"),
        (F.col("n_words") - F.size("shingles") + 1).alias("size"))


def hits(docs: DataFrame, windows: list[tuple], keep: list[str], inside: str | None = None) -> DataFrame:
    """docs with the words that lie in an item's window and the items found there added to its lists.

    docs has the columns of `keep`, hit_words, items and text; `windows` are rows of
    `with_rarest`. The result has the columns of `keep`, n_words, hit_words and items.
    With `inside`, a struct among the columns of `keep`, the text is its field of that name, so that
    it goes to the tasks once.
    """
    by_size: dict[int, dict[int, list[tuple]]] = {}
    for item, text, n_words, shingle, place, size in windows:
        by_size.setdefault(size, {}).setdefault(shingle, []).append((place, n_words, text.encode(), item))
    n_keep = len(keep)
    holder = None if inside is None else keep.index(inside)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {size: Finder(np.array(list(group), np.int64).view(np.uint64)) for size, group in by_size.items()}
        for batch in batches:
            n_words: list[int] = []
            hit_words = [set(x or ()) for x in batch.column(n_keep).to_pylist()]
            items = [set(x or ()) for x in batch.column(n_keep + 1).to_pylist()]
            whole = batch.column(n_keep + 2) if holder is None else batch.column(holder).field("text")
            for at, texts in slices(whole):
                words = Words(texts, ALPHANUMERIC)
                hashes, raw = words.hashes(), None
                for size, finder in finders.items():
                    starts, values = words.shingles(hashes, size)
                    for p in finder.places(values):
                        doc = int(words.text[starts[p]])
                        for place, length, text, item in by_size[size][int(values[p].view(np.int64))]:
                            begin = int(starts[p]) - place
                            # the window must lie inside the document
                            if begin < words.first[doc] or begin + length > words.first[doc + 1]:
                                continue
                            raw = raw or words.bytes.tobytes()
                            if b" ".join(raw[words.begin[i]: words.end[i]] for i in range(begin, begin + length)) == text:
                                begin -= int(words.first[doc])
                                hit_words[at + doc].update(range(begin, begin + length))
                                items[at + doc].add(item)
                n_words.extend(np.diff(words.first).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array(n_words, pa.int64()),
                 pa.array(map(sorted, hit_words), pa.list_(pa.int32())), pa.array(map(list, items), pa.list_(pa.int64()))],
                names=[*keep, "n_words", "hit_words", "items"])

    shape = StructType(list(docs.select(*keep).schema)).add("n_words", "long").add(
        "hit_words", ArrayType(IntegerType())).add("items", ArrayType(LongType()))
    return docs.select(*keep, "hit_words", "items", *([] if inside else ["text"])).mapInArrow(find, shape)


def find_windows(docs: DataFrame, benchmark: DataFrame, sizes: Sizes = Sizes(), keep: tuple[str, ...] = ("doc_id",),
                 block_windows: int = BLOCK_WINDOWS, inside: str | None = None) -> DataFrame:
    """Every row of docs: the columns of `keep`, n_words, hit_words (places), items (ids found).

    A benchmark of more than `block_windows` windows takes one pass over the documents per
    block; each pass adds to the lists of the one before. `inside` is as for `hits`.
    """
    windows = settle(item_windows(benchmark, sizes).dropDuplicates(["item_id", "words"]))
    blocks = max(1, -(-windows.count() // block_windows))
    state = docs.withColumns({"hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<long>")})
    for block in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        wanted = {
            r["size"]: np.array(r["shingles"], np.int64).view(np.uint64) for r in mine.select(
                (F.col("n_words") - F.size("shingles") + 1).alias("size"), F.explode("shingles").alias("s")
            ).groupBy("size").agg(F.collect_set("s").alias("shingles")).collect()}
        chosen = [tuple(r) for r in with_rarest(mine, shingle_counts(docs, wanted)).collect()]
        if block == blocks - 1:
            return hits(state, chosen, list(keep), inside)
        if inside:
            state = settle(hits(state, chosen, list(keep), inside).drop("n_words"))
            continue
        held = hits(state.withColumn("whole_text", F.col("text")), chosen, [*keep, "whole_text"])
        state = settle(held.withColumn("text", F.col("whole_text")).drop("whole_text", "n_words"))


def items_digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    names = F.array_sort(F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: i.cast("string")))
    return F.sha2(F.array_join(names, ","), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = find_windows(docs, benchmark, sizes)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size(F.filter("items", lambda i: i.isNotNull())).cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The rows of docs, with all columns, that hold no window of an item."""
    given = docs.select(F.struct("*").alias("given"), "text")
    return find_windows(given, benchmark, sizes, ("given",), inside="given").filter(F.size("hit_words") == 0).select("given.*")
