"""Phrases whose words come together more often than apart, by counting longest windows once.

1. Texts are cut into pieces and words. `hash_counts` counts words and neighbouring pairs by
   hash, then three words whose pairs are frequent; `frequent` makes Bloom filters of those found
   `min_count` times or more. A candidate holds no other word, pair or triple. The filters have a
   bounded size; what they let through in error is counted like the rest and cut later, so they
   change the work and never the result.
2. `lead_windows`: every frequent word leads one window of the longest order, padded with NULL
   where its piece ends or the next words are not frequent together. Only these windows are
   counted, first in the task, then in a shuffle of one row per task and different window.
3. `phrase_counts`: Spark's ROLLUP over the window's columns sums the windows that share their
   first three, two and one words: a phrase of k words occurs once per window it leads. Rows
   whose last word is padding are no phrases; what is rarer than `min_count` goes.
4. `collocations`: each cut of a candidate looks up its first part and its rest in the same
   counts; a candidate that a longer one with almost the same count contains goes; the best of
   each language stay.

Counts are exact and those of all documents. Keys hold words, so a language or a pair with a
large part of all words is a few rows per task by the time it is shuffled.

Defined results for odd input: a NULL text has no words; a NULL language is `und`; equal rows count as
often as they stand there; pieces never cross documents; an empty table gives an empty result;
other columns, doc_id included, are not looked at. Words are told apart by their code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tables import settle
from docketry.llm.textbytes import STEPS, U64, Words, mixed, slices, table
from docketry.operators.common import top_per

ORDER = 4
SLICE = 400_000
HELD = 3_000_000  # hashes that a task holds before it counts them
FILTER_BITS = 1 << 27  # at most; 16 MB sent to every executor
PROBES = 4
#: bytes that end a piece: . , ; : ! ? and line ends; spaces and tabs stand between words
PIECE_ENDS = table([(b, b) for b in b".,;:!?"] + [(0x0A, 0x0D)])
IN_WORD = ~(PIECE_ENDS | table([(0x20, 0x20), (0x09, 0x09)]))


class Lead:
    """The words of a slice of texts, with hashes of words and of neighbours in one piece, per language."""

    def __init__(self, raw: list[bytes], langs: np.ndarray):
        words = self.words = Words(raw, IN_WORD)
        n = len(words.begin)
        ends = np.concatenate([[0], np.cumsum(PIECE_ENDS[words.bytes])])
        self.lang = langs[words.text]
        #: whether the next word stands in the same piece
        self.linked = np.zeros(n, bool)
        if n > 1:
            self.linked[:-1] = (words.text[1:] == words.text[:-1]) & (ends[words.begin[1:]] == ends[words.end[:-1]])
        plain = words.hashes()
        with np.errstate(over="ignore"):
            seed = mixed(self.lang.astype(U64) + U64(77))
            self.word = mixed(plain ^ seed)
            self.pair = np.zeros(n, U64)
            if n > 1:
                self.pair[:-1] = mixed(plain[:-1] * STEPS[0] + plain[1:] * STEPS[1] + seed[:-1])

    def follows(self, pairs: np.ndarray) -> np.ndarray:
        """Whether a word and the next one stand in one piece and their pair may be frequent."""
        out = self.linked.copy()
        out[out] = holds(pairs, self.pair[out])
        return out

    def two_follow(self, follows: np.ndarray) -> np.ndarray:
        return follows & np.append(follows[1:], np.zeros(min(1, len(follows)), bool))

    def triples(self) -> np.ndarray:
        """A hash of each word and the two after it; of use only where both stand in its piece."""
        with np.errstate(over="ignore"):
            return mixed(self.pair * STEPS[2] + np.append(self.pair[1:], np.zeros(min(1, len(self.pair)), U64)))


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def leads(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[Lead, np.ndarray, list[str]]]:
    """(words of a slice, number of each word's language, names of the numbers)."""
    import xxhash

    names: list[str] = []
    numbers: dict[str, int] = {}
    seeds: list[int] = []  # the same in every task
    for batch in batches:
        of = []
        for name in batch.column(0).to_pylist():
            if name not in numbers:
                numbers[name] = len(names)
                names.append(name)
                seeds.append(xxhash.xxh64_intdigest(name))
            of.append(numbers[name])
        rows = np.array(of, np.int64)
        for first, raw in slices(batch.column(1), slice_bytes):
            own = rows[first: first + len(raw)]
            lead = Lead(raw, np.array(seeds, U64)[own])
            yield lead, own[lead.words.text], names


def hash_counts(docs: DataFrame, pairs: np.ndarray | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, h, c): how often a hash occurs (lang NULL); with h NULL, all words of a language.

    Without `pairs` the hashes are those of words and pairs; with a filter of frequent ones, those
    of three words whose two pairs it holds.
    """
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("c", pa.int64())])
    sent = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total: dict[str, int] = {}
        for lead, lang, names in leads(batches, slice_bytes):
            if sent is None:
                for i, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    total[names[i]] = total.get(names[i], 0) + n
                held += [lead.word, lead.pair[lead.linked]]
            else:
                held.append(lead.triples()[lead.two_follow(lead.follows(sent.value))])
            if sum(map(len, held)) > HELD:
                yield counted(held)
                held = []
        if held:
            yield counted(held)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()))], schema=schema)

    return _given(docs).mapInArrow(run, "lang string, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c"))


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a hash in a filter of `bits` bits."""
    with np.errstate(over="ignore"):
        step = mixed(h) | U64(1)
        return [(h + U64(k) * step) & U64(bits - 1) for k in range(PROBES)]


def frequent(counts: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the hashes of `counts`: twelve bits each, `most_bits` at most (powers of two)."""
    rows = counts.filter("h is not null")
    bits = min(most_bits, max(1 << 16, 1 << (12 * rows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(U64), bits))
            slot, where = np.unique(at >> U64(6), return_inverse=True)
            filled = np.zeros(len(slot), U64)
            np.bitwise_or.at(filled, where, U64(1) << (at & U64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.view(np.int64)), pa.array(filled.view(np.int64))], names=["slot", "bits"])

    made = rows.select("h").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[made["slot"].to_numpy()] = made["bits"].to_numpy().view(U64)
    return out


def holds(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in places(h, len(bloom) * 64):
        found &= (bloom[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1
    return found


class Windows:
    """Windows of several slices, as numbers of words, until they are counted together."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.known, self.held = schema, {}, []

    def __len__(self) -> int:
        return sum(len(c[0]) for c in self.held)

    def add(self, words: Words, used: np.ndarray, lang: np.ndarray, opens: list[np.ndarray]) -> None:
        """Windows of the used words; opens[k] tells where the window reaches k + 1 words on."""
        text, known = words.bytes.tobytes(), self.known
        number = [known.setdefault(text[b:e], len(known)) for b, e in zip(words.begin[used].tolist(), words.end[used].tolist())]
        at = np.full(len(used) + len(opens), -1, np.int64)
        at[: len(used)][used] = number
        self.held.append([lang[used], np.array(number, np.int64), *(
            np.where(o, at[k + 1: k + 1 + len(used)], -1)[used] for k, o in enumerate(opens))])

    def counted(self, names: list[str]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        keys, base = np.zeros(len(columns[0]), np.int64), max(len(self.known), len(names)) + 1
        for column in columns:  # numbers of different rows, one column after the other
            _, keys = np.unique(keys * base + column + 1, return_inverse=True)
        _, one, c = np.unique(keys, return_index=True, return_counts=True)
        spelled = pa.array(list(self.known), pa.binary()).cast(pa.string())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(names).take(pa.array(columns[0][one]))]
            + [spelled.take(pa.array(x[one], mask=x[one] < 0)) for x in columns[1:]] + [pa.array(c.astype(np.int64))],
            schema=self.schema)
        self.known, self.held = {}, []
        return batch


def lead_windows(docs: DataFrame, pairs: np.ndarray, triples: np.ndarray, order: int = ORDER, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, w1 .. w<order>, c): windows led by frequent words, padded with NULL, counted in the task."""
    columns = [f"w{k + 1}" for k in range(order)]
    schema = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in columns), ("c", pa.int64())])
    sent = docs.sparkSession.sparkContext.broadcast((pairs, triples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = Windows(schema), []
        two, three = sent.value
        for lead, lang, names in leads(batches, slice_bytes):
            follows = lead.follows(two)
            used = holds(two, lead.word) | follows
            used[1:] |= follows[:-1]
            both = lead.two_follow(follows)
            both[both] = holds(three, lead.triples()[both])
            opens = [follows]  # the window reaches a word further where the last three words are frequent
            for k in range(2, order):
                opens.append(opens[-1] & np.append(both[k - 2:], np.zeros(min(k - 2, len(both)), bool)))
            if used.any():
                found.add(lead.words, used, lang, opens)
            if len(found) > HELD // 8:
                yield found.counted(names)
        if found.held:
            yield found.counted(names)

    return _given(docs).mapInArrow(run, f"lang string, {', '.join(f'{w} string' for w in columns)}, c long")


def phrase_counts(docs: DataFrame, min_count: int = 30, order: int = ORDER, most_bits: int = FILTER_BITS,
                  slice_bytes: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """((lang, words, f): phrases of up to `order` words found `min_count` times; (lang, n): all words)."""
    counts = settle(hash_counts(docs, None, slice_bytes).filter((F.col("c") >= min_count) | F.col("h").isNull()))
    pairs = frequent(counts, most_bits)
    triples = frequent(settle(hash_counts(docs, pairs, slice_bytes).filter(F.col("c") >= min_count)), most_bits)
    names = [f"w{k + 1}" for k in range(order)]
    longest = lead_windows(docs, pairs, triples, order, slice_bytes).groupBy("lang", *names).agg(F.sum("c").alias("c"))
    sums = longest.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("left_out")).filter(F.col("f") >= min_count)
    # a prefix of k words leaves out the last order - k columns; it is a phrase if its last word is none of the padding
    whole = F.coalesce(*[
        F.when(F.col("left_out") == (1 << (order - k)) - 1, F.col(f"w{k}").isNotNull()) for k in range(1, order + 1)], F.lit(False))
    phrases = sums.filter(whole).select("lang", F.array_compact(F.array(*names)).alias("words"), "f")
    return settle(phrases), counts.filter("h is null").select("lang", F.col("c").alias("n"))


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, scale: int = 2_000_000, inside: int = 80,
                 order: int = ORDER, most_bits: int = FILTER_BITS, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    The score of a cut is floor(scale * a / (l + r)) of the counts of phrase, first part and rest;
    the lowest cut counts, the earliest of equals. A phrase inside a longer one that has at least
    `inside` percent of its count is left out.
    """
    phrases, total = phrase_counts(docs, min_count, order, most_bits, slice_bytes)
    counted = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "f")
    candidates = phrases.filter(F.size("words") > 1)

    def run(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "k",
        run(F.lit(1), F.col("k")).alias("head"), run(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    exact = "decimal(19,0)"
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn(
        "score", F.expr(f"cast({int(scale)} as decimal(10,0)) * cast(a as {exact}) div (cast(l as {exact}) + cast(r as {exact}))"))
    best = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the longest run of the parts of longer candidates, by the count of the candidate
    parts = candidates.filter(F.size("words") > 2).withColumn(
        "length", F.explode(F.sequence(F.lit(2), F.size("words") - 1))).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    held = parts.groupBy("lang", run(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(exact) * 100 < F.col("a").cast(exact) * inside))
    ranked = top_per(
        kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), ["lang"],
        [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
