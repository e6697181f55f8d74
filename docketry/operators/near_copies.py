"""Near copies across a corpus: the rule of `dedupe_similar_chunks` without a question to group by.

Texts are taken best first; one is a copy if an earlier kept text contains it, lies in it, or is at
least `threshold` similar (Indel ratio). All pairs are never compared:

- Equal texts are one class, decided by its first row.
- Similar texts of up to `short` characters share at least one of their rarest character grams: a
  ratio of t leaves at least (2q-1)L - (q-1)(a+b) - q + 1 grams of q characters, L = t(a+b)/2, so
  that many grams less one of each may be left out, the frequent ones. This misses nothing.
- Longer texts meet on winnowed fingerprints: two texts with a common run of RUN characters share
  one. The most frequent quarter of a text's fingerprints is left out, so of the longer texts those
  pairs are compared that share a run that is not among the commonest of both. Similar texts whose
  changes leave no such run are not found.
- A contained text meets its hosts on its rarest fingerprint (or gram, if shorter than RUN), of
  which any host has all. This misses nothing either.

Keeping goes in rounds. A text that is the first of every key it has can be kept; the others at its
keys are compared with it and leave if alike. A group of near copies thus costs a row per member
and key, not a pair per pair. After `ROUNDS` rounds what is left is compared pair by pair, and the
same rounds go on over the pairs found alike, until nothing is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.grams import TABLE, U64, from_texts, grams, numbered, rare_first
from docketry.functions.grams import points as points_of
from docketry.functions.grams import slot as slot_of
from docketry.functions.text import normalize_ws
from docketry.operators.similarity import at_least
from docketry.session import settle

GRAM, WINDOW = 8, 13
RUN = GRAM + WINDOW - 1  # characters in a row that two texts share at least one fingerprint on
SHORT = 200
ROUNDS = 8
MEMBER = "key long, kind string, id {kind}, neg double, size int"


def _fingerprints(points: np.ndarray) -> np.ndarray:
    """The least gram hash of every window, each once."""
    h = grams(points, GRAM)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(1)) if len(h) >= WINDOW else np.zeros(0, U64)


class Rule:
    """Which grams of a text it must be looked up by, for a threshold."""

    def __init__(self, threshold: float, short: int):
        self.t, self.short = threshold, short
        bound = (1 - threshold / 2) / (1 - threshold) if threshold < 1 else 9
        self.q = max(1, min(6, int(np.ceil(bound)) - 1))
        self.least = threshold / (2 - threshold)  # of the longer length
        self.gain = (2 * self.q - 1) * threshold / 2 - (self.q - 1)
        #: from this sum of lengths on, similar texts share a gram of q characters
        self.sum = int(np.ceil((self.q + 1) / self.gain))

    def sized(self, n: int, q: int) -> int:
        """Grams of q characters that a text of n characters is looked up by."""
        partner = max(int(np.ceil(self.least * n - 1e-9)), 1, self.sum - n if q > 1 else 1)
        gain = (2 * q - 1) * self.t / 2 - (q - 1)
        must = int(np.ceil(gain * (n + partner) - q + 1 - 1e-9))
        return max(0, n - q + 1) - max(must, 1) + 1

    def kinds(self, n: int) -> list[int]:
        """Sizes of the grams by which a text of n characters may meet a similar one of up to `short`."""
        if n * self.least > self.short:
            return []
        return ([1] if n < self.sum and self.q > 1 else []) + ([self.q] if self.q == 1 or n * (1 + 1 / self.least) >= self.sum else [])


def _counts(texts: DataFrame, rule: Rule) -> np.ndarray:
    """How often each slot's grams are looked up or held; a table of fixed size."""
    def slots(text: str) -> dict:
        points = points_of(text)
        h = [_fingerprints(points)] + [numbered(grams(points, q)) for q in rule.kinds(len(points))]
        if len(points) < RUN:
            h.append(grams(points, min(3, len(points))))
        slot, c = np.unique(slot_of(np.concatenate(h)), return_counts=True)
        return {"slot": slot, "c": c.astype(np.int64)}

    made = from_texts(texts.select("text"), "slot long, c long", slots).groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(TABLE, np.int64)
    out[made["slot"].to_numpy()] = made["c"].to_numpy()
    return out


def _members(texts: DataFrame, rule: Rule, counts: np.ndarray) -> DataFrame:
    """(key, kind, id, neg, size): s rows meet each other, a p row meets p and h rows of its key."""
    def rarest(points: np.ndarray) -> np.ndarray:
        h = _fingerprints(points) if len(points) >= RUN else grams(points, min(3, len(points)))
        return rare_first(h, counts)[:1]

    # which short grams anybody looks for: a table of fixed size, empty where no text is that short
    asked = np.zeros(TABLE, bool)
    tiny = texts.filter(F.length("text") < RUN).select("text")
    asked[from_texts(tiny, "slot long", lambda t: {"slot": slot_of(rarest(points_of(t)))}).distinct().toArrow()["slot"].to_numpy()] = True
    any_tiny = bool(asked.any())

    def keys(text: str) -> dict:
        points = points_of(text)
        similar = [rare_first(numbered(grams(points, q)), counts)[: rule.sized(len(points), q)] ^ U64(q) for q in rule.kinds(len(points))]
        marks = _fingerprints(points)
        if len(points) > rule.short:
            similar.append(rare_first(marks, counts)[: len(marks) - len(marks) // 4] ^ U64(99))
        hosts = [marks]
        if any_tiny:
            tiny_grams = np.unique(np.concatenate([grams(points, q) for q in (1, 2, 3)]))
            hosts.append(tiny_grams[asked[slot_of(tiny_grams)]])
        probe = rarest(points)
        host = np.setdiff1d(np.concatenate(hosts), probe)
        s = np.concatenate(similar) if similar else np.zeros(0, U64)
        key = np.concatenate([s, probe ^ U64(77), host ^ U64(77)])
        return {"key": key.view(np.int64), "kind": np.repeat(np.array(["s", "p", "h"]), [len(s), len(probe), len(host)]),
                "size": np.full(len(key), len(points), np.int32)}

    return from_texts(texts.select("id", "neg", "text"), MEMBER.format(kind=dict(texts.dtypes)["id"]), keys)


def _needed(members: DataFrame) -> DataFrame:
    """Rows at keys where somebody can be met."""
    met = members.groupBy("key").agg(
        F.count_if(F.col("kind") == "s").alias("s"), F.count_if(F.col("kind") == "p").alias("p"),
        F.count(F.lit(1)).alias("n")).filter((F.col("s") > 1) | ((F.col("p") > 0) & (F.col("n") > 1))).select("key")
    return members.join(met, "key", "left_semi")


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (id, by) whose texts are alike by the rule."""
    kind = dict(pairs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            hit = [x in y or y in x or at_least(x, y, threshold) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).filter(pa.array(hit, pa.bool_())) for k in range(2)], names=["id", "by"])

    near = texts.select("id", F.col("text").alias("a"))
    far = texts.select(F.col("id").alias("by"), F.col("text").alias("b"))
    return pairs.join(near, "id").join(far, "by").select("id", "by", "a", "b").mapInArrow(run, f"id {kind}, by {kind}")


def _met(kept: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(id, by): members of `others` that meet one of `kept` at a key.

    Of those that meet as similar, pairs whose lengths alone rule that out are left out here, before
    texts are sent; one that lies in the other meets it as p and h too.
    """
    k = kept.select("key", F.col("kind").alias("by_kind"), F.col("id").alias("by"), F.col("neg").alias("by_neg"), F.col("size").alias("by_size"))
    fits = 2.0 * F.least("size", "by_size") / (F.col("size") + F.col("by_size")) >= threshold
    may = (F.col("kind") == "s") & (F.col("by_kind") == "s") & fits | (F.col("kind") == "p") & (F.col("by_kind") != "s") \
        | (F.col("kind") == "h") & (F.col("by_kind") == "p")
    return others.join(k, "key").filter(may & (F.col("id") != F.col("by")))


def corpus_near_duplicates(docs: DataFrame, threshold: float = 0.85, short: int = SHORT, rounds: int = ROUNDS) -> DataFrame:
    """(document_id, kept, duplicate_of) for rows (document_id, content, score).

    Rows are taken by score, highest first, ties by id. `duplicate_of` is the first kept row that a
    dropped one is alike to. Texts are compared lower-cased, white space reduced; a NULL or empty
    text is never a copy. document_id must be unique.
    """
    rule = Rule(threshold, short)
    rows = settle(docs.select(
        F.col("document_id").alias("id"), (-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("neg"),
        F.coalesce(F.lower(normalize_ws(F.col("content"))), F.lit("")).alias("text")))
    order = F.struct("neg", "id")
    digest = F.sha2("text", 256)
    first = rows.filter("text <> ''").groupBy(digest.alias("digest")).agg(F.min(order).alias("first"))
    named = settle(rows.filter("text <> ''").select("id", "neg", digest.alias("digest")).join(first, "digest").select(
        "id", F.col("first.id").alias("head"), "neg"))
    texts = settle(rows.join(named.filter("id = head").select("id"), "id", "left_semi"))
    members = settle(_needed(_members(texts, rule, _counts(texts, rule))))
    open_, kept_parts, dropped = members, [], []
    for number in range(1, 1 << 30):
        if open_.isEmpty():
            break
        if number == rounds:  # the rest pair by pair; each pair found alike is a key of its own
            pairs = _met(open_, open_, threshold).filter(F.struct("by_neg", "by") < order).select("id", "by").distinct()
            found = _alike(pairs, texts, threshold).select(F.xxhash64("id", "by").alias("key"), F.explode(F.array("id", "by")).alias("id"))
            alone = open_.select("id", "neg").distinct()
            linked = settle(found.join(alone, "id").select("key", F.lit("s").alias("kind"), "id", "neg", F.lit(1).alias("size")))  # alike whatever their lengths
            kept_parts.append(settle(alone.select("id").join(linked.select("id"), "id", "left_anti")))
            open_ = linked
            continue

        def at(kind: str):
            return F.min(F.when(F.col("kind") == kind, order))

        firsts = open_.groupBy("key").agg(at("s").alias("s"), at("p").alias("p"), at("h").alias("h"))
        ahead = F.when(F.col("kind") == "s", F.col("s")).when(F.col("kind") == "h", F.col("p")).otherwise(F.least("p", "h"))
        free = settle(open_.join(firsts, "key").groupBy("id", "neg").agg(F.min(ahead).alias("ahead")).filter(
            F.col("ahead").isNull() | (F.col("ahead") >= order)).select("id"))
        now = open_.join(free, "id", "left_semi")
        rest = open_.join(free, "id", "left_anti")
        hits = settle(_alike(_met(now, rest, threshold).select("id", "by").distinct(), texts, threshold).select("id").distinct())
        kept_parts.append(free)
        dropped.append(hits)
        open_ = settle(rest.join(hits, "id", "left_anti"))
    return _answer(rows, named, texts, members, dropped, threshold)


def _answer(rows: DataFrame, named: DataFrame, texts: DataFrame, members: DataFrame, dropped: list[DataFrame],
            threshold: float) -> DataFrame:
    """Every row with its verdict; of the kept ones that a dropped text is alike to, the first."""
    gone = rows.select("id").limit(0)
    for part in dropped:
        gone = gone.unionByName(part)
    gone = settle(gone)
    stay, left = members.join(gone, "id", "left_anti"), members.join(gone, "id", "left_semi")
    pairs = _met(stay, left, threshold).filter(F.struct("by_neg", "by") < F.struct("neg", "id")).select("id", "by").distinct()
    order = texts.select(F.col("id").alias("by"), "neg")
    of = _alike(pairs, texts, threshold).join(order, "by").groupBy("id").agg(F.min(F.struct("neg", F.col("by").alias("id"))).alias("m"))
    heads = of.select(F.col("id").alias("head"), F.col("m.id").alias("of"))
    copies = named.select("id", "head").join(heads, "head", "left").select(
        "id", F.coalesce("of", F.when(F.col("id") != F.col("head"), F.col("head"))).alias("duplicate_of"))
    return rows.select("id").join(copies, "id", "left").select(
        F.col("id").alias("document_id"), F.col("duplicate_of").isNull().alias("kept"), "duplicate_of")
