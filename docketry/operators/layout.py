"""Fields from positioned words.

Words: doc_id, word_idx, page, x0, y0, x1, y1, text, conf, source; word_idx follows
the order of pages. Labels: doc_id, label_id, page, field, text, score, x0, y0, x1, y1.

Labels and words meet per page and per vertical band. A label reaches only the bands
where a word can score, so a crowded page is worked on band by band.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions import geometry as geo
from docketry.functions.grams import from_texts
from docketry.functions.text import let, normalize_ws
from docketry.functions.values import (
    candidate_confidence, normalize_label, normalize_registration, parse_day_first,
    relation_confidence, token_shape_flags,
)
from docketry.operators.common import top_per
from docketry.operators.near_copies import Rule
from docketry.operators.similarity import ratio
from docketry.session import settle, settle_by

BAND = 64.0
BOX = ["x0", "y0", "x1", "y1"]
_LABEL_NOISE = "[" + vocab.LABEL_QUOTES + r"\x{200e}\x{200f}]"
VALUE_ENDS = r"^[ :־\-]+|[ :־\-]+$"


# --- rows of a page ----------------------------------------------------------------------
def median_word_height(words: DataFrame) -> DataFrame:
    """(doc_id, h): upper median of word heights.

    The discrete median from the tall end is the upper one; Spark counts distinct
    heights instead of collecting them.
    """
    tall = words.select("doc_id", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"))
    return tall.groupBy("doc_id").agg(
        F.expr("percentile_disc(0.5) within group (order by h desc)").alias("h"))


def _lines(words: DataFrame, tol: float) -> DataFrame:
    """(doc_id, page, cy, h, first, island): the different heights of a page, in groups that are
    further apart than any row reaches.

    Words of equal center and height always share a row, so the first of them stands for all.
    A page is cut into cells as high as its tallest reach; an empty cell is a gap that no row
    crosses, and the cells between two gaps are an island.
    """
    lines = settle(words.select(
        "doc_id", "page", ((F.col("y0") + F.col("y1")) / 2).alias("cy"),
        F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"), "word_idx",
    ).groupBy("doc_id", "page", "cy", "h").agg(F.min("word_idx").alias("first")))
    pages = ["doc_id", "page"]
    tall = lines.groupBy(*pages).agg((tol * F.max("h")).alias("reach"))
    # a little higher than the reach, for rounding
    celled = lines.join(tall, pages).withColumn("cell", F.floor(F.col("cy") / (F.greatest(F.col("reach"), F.lit(1e-9)) * 1.000001)))
    occupied = celled.select(*pages, "cell").distinct()
    along = Window.partitionBy(*pages).orderBy("cell")
    opens = F.when(F.col("cell") - F.lag("cell").over(along) > 1, F.col("cell"))
    islands = occupied.withColumn("opens", opens).withColumn(
        "island", F.coalesce(F.last("opens", ignorenulls=True).over(along), F.first("cell").over(along))).drop("opens")
    return celled.join(islands, [*pages, "cell"]).drop("cell")


def visual_rows(words: DataFrame, tol: float = 0.6) -> DataFrame:
    """Words with row_id: the number of their visual row on the page.

    In order of height a word joins the first row whose first word is within
    `tol` heights, else it opens a row. Rows depend on the rows before them, but not
    across a gap: pages are cut into islands, each is walked once in order on narrow
    rows, and the rows of earlier islands are added up.
    """
    keys = ["doc_id", "page", "island"]
    ordered = _lines(words, tol).repartition(*keys).sortWithinPartitions(*keys, "cy", "first")
    kinds = dict(ordered.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, opened = None, deque(), 0
        for batch in batches:
            ids = []
            for doc, page, island, cy, high, reach in zip(*(batch[c].to_pylist() for c in (*keys, "cy", "h", "reach")), strict=True):
                if (doc, page, island) != place:
                    place, rows, opened = (doc, page, island), deque(), 0
                while rows and cy - rows[0][0] > reach:
                    rows.popleft()
                for row in rows:
                    if cy - row[0] <= tol * max(row[1], high):
                        break
                else:
                    row = (cy, high, opened)
                    rows.append(row)
                    opened += 1
                ids.append(row[2])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in (*keys, "cy", "h")), pa.array(ids, pa.int32())], names=[*keys, "cy", "h", "nth"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "cy", "h")) + ", nth int"
    walked = settle(ordered.select(*keys, "cy", "h", "reach").mapInArrow(walk, schema))
    counts = walked.groupBy(*keys).agg((F.max("nth") + 1).alias("rows"))
    before = Window.partitionBy("doc_id", "page").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    numbered = walked.join(offsets, keys).select(
        "doc_id", "page", "cy", "h", (F.col("earlier") + F.col("nth")).cast("int").alias("row_id"))
    sized = words.withColumns({
        "cy": (F.col("y0") + F.col("y1")) / 2, "h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})
    return sized.join(numbered, ["doc_id", "page", "cy", "h"]).select(*words.columns, "cy", "h", "row_id")


# --- labels --------------------------------------------------------------------------------
def _anchor_rows(anchors: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(field, phrase) in order, phrases normalized as `normalize_label` does."""
    import re

    out = []
    for field, phrases in anchors.items():
        for phrase in phrases:
            bare = re.sub(f"[{re.escape(vocab.LABEL_QUOTES)}‎‏]", "", phrase)
            out.append((field, re.sub(r"\s+", " ", bare).strip().strip(" :.-")))
    return out


_NO_SIGN = " :.-"  # left out of letter signs: they may be trimmed
SPELLED_OUT = 24
FEW_ANCHORS = 200  # up to so many, runs are sifted by the letters of each anchor first


def _sign_of(text: str) -> int:
    """The letters of a text as bits of a 63-bit number."""
    out = 0
    for c in text:
        if c not in _NO_SIGN:
            out |= 1 << (ord(c) % 63)
    return out


def _letters(text: Column) -> Column:
    """`_sign_of` of a text column, 0 for NULL."""
    bits = F.aggregate(F.split(F.translate(text, _NO_SIGN, ""), ""), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(
        F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 63).cast("int")))))
    return F.coalesce(bits, F.lit(0).cast("long"))


def _sifted(letters: Column, anchors: dict[str, list[str]], threshold: float) -> Column:
    """Can a phrase with these letters be like an anchor or hold it? Every letter that only one of
    two texts has is an edit, so a no is final."""
    signs: dict[int, tuple[int, bool]] = {}
    for _, text in _anchor_rows(anchors):
        slack = max(3, len(text) // 4)
        room = int((2 * len(text) + slack) * (1 - threshold) + 1e-9)
        before = signs.get(_sign_of(text), (0, False))
        signs[_sign_of(text)] = (max(room, before[0]), before[1] or " " in text)
    found = F.lit(False)
    if len(signs) <= SPELLED_OUT:
        for sign, (room, several) in signs.items():
            missing = F.bit_count(F.lit(sign).cast("long").bitwiseAND(F.bitwise_not(letters)))
            extra = F.bit_count(letters.bitwiseAND(F.lit(~sign).cast("long")))
            found = found | (missing <= F.when(F.lit(several), 0).otherwise(-1)) | (missing + extra <= room)
        return found
    # spelled out, a longer test would outgrow what the JVM compiles
    listed = F.array(*[F.struct(
        F.lit(sign).cast("long").alias("sign"), F.lit(room).alias("room"), F.lit(0 if several else -1).alias("free"))
        for sign, (room, several) in signs.items()])

    def near(a: Column) -> Column:
        missing = F.bit_count(a["sign"].bitwiseAND(F.bitwise_not(letters)))
        extra = F.bit_count(letters.bitwiseAND(F.bitwise_not(a["sign"])))
        return (missing <= a["free"]) | (missing + extra <= a["room"])

    return F.exists(listed, near)


def _sized(norm: Column, anchors: dict[str, list[str]]) -> Column:
    """Is a normalized phrase about as long as an anchor, or does it hold one? `_plausible` is never
    true without; this asks less, but in plain comparisons, and most runs go here."""
    sizes, several = set(), set()
    for _, text in _anchor_rows(anchors):
        slack = max(3, len(text) // 4)
        sizes.update(range(len(text) - slack, len(text) + slack + 1))
        if " " in text:
            several.add(text)
    found = F.length(norm).isin(*sizes)
    if len(several) > SPELLED_OUT:
        return found | F.exists(F.array(*map(F.lit, sorted(several))), lambda a: F.contains(norm, a))
    for text in sorted(several):
        found = found | F.contains(norm, F.lit(text))
    return found


def _plausible(norm: Column, anchors: dict[str, list[str]], threshold: float) -> Column:
    """Can a normalized phrase reach the threshold for some anchor?

    Decides what `match_label` compares. An Indel ratio of t leaves room for at most
    (1 - t) of both lengths in edits, and the edit distance is never above that number.
    """
    texts = list(dict.fromkeys(text for _, text in _anchor_rows(anchors)))
    by_words: dict[int, list[str]] = {}
    for text in texts:
        by_words.setdefault(len(text.split()), []).append(text)

    def listed(some: list[str]) -> Column:
        # text, length, allowed difference in length, most edits within that difference
        slack = {t: max(3, len(t) // 4) for t in some}
        return F.array(*[F.struct(
            F.lit(t).alias("text"), F.lit(len(t)).alias("size"), F.lit(slack[t]).alias("slack"),
            F.lit(int((2 * len(t) + slack[t]) * (1 - threshold) + 1e-9)).alias("room")) for t in some])

    def test(p: Column) -> Column:
        found = F.lit(False)
        for words in range(1, max(by_words) + 2):
            alike, held = by_words.get(words, []), [
                t for n in (words - 1, words) if n >= 2 for t in by_words.get(n, [])]
            some = F.lit(False)
            if alike:
                some = some | F.exists(listed(alike), lambda a: (
                    (F.abs(p["size"] - a["size"]) <= a["slack"])
                    & (F.call_function("levenshtein", p["text"], a["text"], a["room"]) >= 0)))
            if held:
                some = some | F.exists(listed(held), lambda a: F.contains(p["text"], a["text"]))
            found = F.when(p["words"] == words, some).otherwise(found)
        return found

    return let(F.struct(norm.alias("text"), F.length(norm).alias("size"),
                        F.size(F.split(norm, " ")).alias("words")), test)


def _grams_of(text: str, q: int) -> list[tuple[str, int]]:
    """Runs of q characters, equal ones numbered."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - q + 1):
        g = text[i: i + q]
        seen[g] = nth = seen.get(g, 0) + 1
        out.append((g, nth))
    return out


def _label_keys(text: str, counts: dict[tuple[str, int], int], rule: Rule, is_anchor: bool) -> set[int]:
    """Keys at which a phrase meets every anchor it is like or holds.

    Alike: the rarest of its grams, by number of words (`near_copies.Rule`). Held: an anchor of
    several words brings the letters around its first gap, a phrase those around all of its gaps.
    """
    words = text.split(" ")
    keys = set()
    for q in rule.kinds(len(text)):
        rare = sorted(_grams_of(text, q), key=lambda g: (counts.get(g, 0), g))
        keys.update(xxhash.xxh64_intdigest(f"{len(words)} {q} {nth} {g}") for g, nth in rare[: rule.sized(len(text), q)])
    for left, right in zip(words[:1] if is_anchor else words, words[1:]):
        sizes = [(min(3, len(left)), min(3, len(right)))] if is_anchor else [
            (i, j) for i in range(1, min(3, len(left)) + 1) for j in range(1, min(3, len(right)) + 1)]
        keys.update(xxhash.xxh64_intdigest(f"{left[-i:]} {right[:j]}") for i, j in sizes if i and j)
    return keys


def _match_normalized(phrases: DataFrame, anchors: dict[str, list[str]], threshold: float) -> DataFrame:
    """phrases(norm) -> distinct (norm, field, score) of those that are a label.

    Distinct phrases and anchors meet on keys; only what meets is compared, so the anchors may
    be many.
    """
    spark = phrases.sparkSession
    rows = [(i, field, text) for i, (field, text) in enumerate(_anchor_rows(anchors))]
    if not rows:
        return spark.createDataFrame([], "norm string, field string, score double")
    rule = Rule(threshold, 1 << 20)
    counts: dict[tuple[str, int], int] = {}
    for _, _, text in rows:
        for q in rule.kinds(len(text)):
            for g in _grams_of(text, q):
                counts[g] = counts.get(g, 0) + 1

    def keys(is_anchor: bool):
        return lambda text: {"key": np.array(list(_label_keys(text, counts, rule, is_anchor)), np.uint64).view(np.int64)}

    known = spark.createDataFrame(rows, "nth int, field string, text string")
    # spread by number: few bytes of phrases are much work
    distinct = phrases.filter("norm <> ''").select("norm").distinct().repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "norm").withColumn("text", F.col("norm"))
    if len(rows) <= FEW_ANCHORS:  # a short constant list needs no keys
        listed = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(f).alias("field"), F.lit(t).alias("text")) for i, f, t in rows])
        pairs = distinct.select("norm", F.inline(listed))
    else:
        anchor_keys = from_texts(known.select("nth", "text"), "nth int, key long", keys(True))
        met = from_texts(distinct, "norm string, key long", keys(False)).join(anchor_keys, "key").select("norm", "nth").distinct()
        pairs = settle(met.join(known, "nth"))

    @F.pandas_udf("double")
    def alike(texts: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(texts, others)], dtype="float64")

    words, own = F.size(F.split("norm", " ")), F.size(F.split("text", " "))
    slack = F.greatest(F.lit(3), F.floor(F.length("text") / 4))
    held = (own >= 2) & F.contains("norm", "text") & (words <= own + 1)
    plain = F.when(F.col("norm") == F.col("text"), 1.0).when(held, 0.9)
    # only what needs it is sent to be compared
    room = F.floor((F.length("norm") + F.length("text")) * (1 - threshold) + 1e-9).cast("int")
    close = pairs.filter(plain.isNull() & (words == own) & (F.abs(F.length("norm") - F.length("text")) <= slack)
                         & (F.levenshtein("norm", "text") <= room))  # never above the Indel distance
    scored = pairs.withColumn("score", plain).filter("score is not null").unionByName(
        close.withColumn("score", alike(F.col("norm"), F.col("text"))))
    return scored.filter(F.col("score") >= threshold).groupBy("norm").agg(
        F.max(F.struct("score", (-F.col("nth")).alias("first"), "field")).alias("m")).select("norm", "m.field", "m.score")


def match_label(phrases: DataFrame, anchors: dict[str, list[str]] = vocab.ANCHORS,
                threshold: float = vocab.LABEL_THRESHOLD) -> DataFrame:
    """phrases(phrase) -> distinct (phrase, field, score) of those that are a label.

    Equal to an anchor: 1. Holds an anchor of two or more words and at most one word
    more: 0.9. As many words and about as long: Indel ratio. First best anchor wins.
    Only phrases close enough to an anchor are shuffled and compared.
    """
    near = phrases.select("phrase", normalize_label(F.col("phrase")).alias("norm"))
    if len(_anchor_rows(anchors)) <= FEW_ANCHORS:
        near = near.filter(_sifted(_letters(F.col("norm")), anchors, threshold) & _plausible(F.col("norm"), anchors, threshold))
    near = settle(near.distinct())
    return near.join(_match_normalized(near, anchors, threshold), "norm").select("phrase", "field", "score")


def label_hits(rows: DataFrame, anchors: dict[str, list[str]] = vocab.ANCHORS, max_span: int = 4,
               heights: DataFrame | None = None) -> DataFrame:
    """Labels among the words of `visual_rows`: runs of up to max_span words with small
    gaps, read in both directions. Columns of a label plus its place in reading order.

    `heights` are the median word heights, where the caller has them already.
    """
    heights = median_word_height(rows) if heights is None else heights
    rows = geo.with_center(rows)
    along = Window.partitionBy("doc_id", "page", "row_id").orderBy("x0", "cy", "word_idx")
    bare = F.nullif(F.regexp_replace("text", _LABEL_NOISE, ""), F.lit(""))
    sift = len(_anchor_rows(anchors)) <= FEW_ANCHORS
    # worked out once per word, below the shuffle
    rows = rows.withColumn("bare", bare)
    rows = rows.withColumn("sign", _letters(F.col("bare")) if sift else F.lit(0).cast("long"))
    own = F.struct("text", "bare", "sign", *BOX)
    wide = rows.join(heights.withColumnRenamed("h", "median"), "doc_id").select(
        "doc_id", "page", "row_id", F.row_number().over(along).alias("pos"),
        F.greatest(F.lit(20.0), 2.5 * F.col("median")).alias("gap"), own.alias("w0"),
        *[F.lead(own, k).over(along).alias(f"w{k}") for k in range(1, max_span)])
    members = [F.col(f"w{k}") for k in range(max_span)]

    def phrase(part: list[Column]) -> Column:
        return F.btrim(F.concat_ws(" ", *[m["bare"] for m in part]), F.lit(" :.-"))

    threshold = vocab.LABEL_THRESHOLD
    spans, joined, letters = [], F.lit(True), F.lit(0).cast("long")
    for n in range(1, max_span + 1):
        if n > 1:
            before, last = members[n - 2], members[n - 1]
            joined = joined & last.isNotNull() & (last["x0"] - before["x1"] <= F.col("gap"))
        letters = letters.bitwiseOR(F.coalesce(members[n - 1]["sign"], F.lit(0).cast("long")))
        spans.append(F.struct(F.when(joined, n).alias("span"), letters.alias("letters")))
    runs = wide.withColumn("s", F.explode(F.array(*spans))).select(
        "doc_id", "page", "row_id", "pos", *[f"w{k}" for k in range(max_span)], "s.*").filter("span is not null")
    if sift:
        runs = runs.filter(_sifted(F.col("letters"), anchors, threshold))

    def read_as(order) -> Column:
        return F.coalesce(*[F.when(F.col("span") == n, phrase(order(members[:n]))) for n in range(1, max_span + 1)])

    # inline keeps both readings from being put together again for every test below
    backward = F.when(F.col("span") > 1, read_as(lambda part: part[::-1])).otherwise("")
    runs = runs.select("*", F.inline(F.array(F.struct(read_as(list).alias("lr_norm"), backward.alias("rl_norm")))))
    if sift:
        runs = runs.filter(_sized(F.col("lr_norm"), anchors) | _sized(F.col("rl_norm"), anchors)).filter(_plausible(F.col("lr_norm"), anchors, threshold) | _plausible(F.col("rl_norm"), anchors, threshold))
    part = F.slice(F.array(*members), 1, F.col("span"))
    text = F.transform(part, lambda m: m["text"])

    def edge(pick, name: str) -> Column:
        return pick(F.transform(part, lambda m: m[name])).alias(name)

    # few are left; they are read three times below
    runs = settle(runs.select(
        "doc_id", "page", "row_id", "pos", "span", "lr_norm", "rl_norm", F.array_join(text, " ").alias("lr_text"),
        F.when(F.col("span") > 1, F.array_join(F.reverse(text), " ")).alias("rl_text"),
        edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1")), in_place=True)
    # of known size: as long as the different labels are few, runs stay where they are
    matches = settle(_match_normalized(
        runs.select(F.explode(F.array("lr_norm", "rl_norm")).alias("norm")), anchors, threshold))

    def read(name: str) -> DataFrame:
        return matches.select(F.col("norm").alias(f"{name}_norm"), F.struct("field", "score").alias(f"{name}_hit"))

    hits = runs.join(read("lr"), "lr_norm", "left").join(read("rl"), "rl_norm", "left")
    backwards = F.coalesce("rl_hit.score", F.lit(0.0)) > F.coalesce("lr_hit.score", F.lit(0.0))
    hit = F.when(backwards, F.col("rl_hit")).otherwise(F.col("lr_hit"))
    return hits.filter(hit["field"].isNotNull()).select(
        "doc_id", "page", "row_id", "pos", "span", hit["field"].alias("field"),
        F.when(backwards, F.col("rl_text")).otherwise(F.col("lr_text")).alias("text"), hit["score"].alias("score"), *BOX)


def _label_order() -> list[Column]:
    y = (F.col("y0") + F.col("y1")) / 2
    return [F.bround(y, 0), F.desc("score"), F.desc(F.col("x1") - F.col("x0")), "page", "row_id", "pos", "span"]


def label_hit_dedupe(hits: DataFrame, per_page: bool = False) -> DataFrame:
    """The first hit per field and rough position; adds label_id.

    Positions are rounded half to even. Pages are not told apart unless per_page.
    """
    spot = hits.withColumns({
        "spot_y": F.bround((F.col("y0") + F.col("y1")) / 2 / 6, 0),
        "spot_x": F.bround((F.col("x0") + F.col("x1")) / 2 / 40, 0)})
    keys = ["doc_id", "field", "spot_y", "spot_x"] + (["page"] if per_page else [])
    kept = top_per(spot, keys, _label_order(), 1, "copy").drop("copy", "spot_y", "spot_x")
    return kept.withColumn("label_id", F.concat_ws("|", "field", "page", *BOX))


def anchors_detected(labels: DataFrame) -> DataFrame:
    """(doc_id, texts): sorted distinct label texts of a document."""
    return labels.groupBy("doc_id").agg(F.array_sort(F.collect_set("text")).alias("texts"))


# --- labels and words ------------------------------------------------------------------------
def _as_box(df: DataFrame, name: str) -> Column:
    return F.struct(*[c for c in df.columns if c not in ("doc_id", "label_id")]).alias(name)


def _as_columns(df: DataFrame, name: str) -> dict[str, Column]:
    """The fields of `_as_box` as columns of their own, by name."""
    return {c: F.col(f"{name}_{c}") for c in df.columns if c not in ("doc_id", "label_id")}


def _in_reach(labels: DataFrame, words: DataFrame, positive: bool) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """(doc_id, label_id, l_..., w_...) of the words in the bands a label reaches, and the columns
    of label and word by name; sideways too when only positive scores matter.

    Label and word stay single columns, so that those nobody reads are not shuffled.
    """
    labels, words = geo.with_center(labels), geo.with_center(words)
    label, word = _as_columns(labels, "l"), _as_columns(words, "w")
    left = labels.select("doc_id", "page", "label_id", *[F.col(c).alias(f"l_{c}") for c in label])
    reach = geo.reach_of(label)
    left = left.withColumn("band", F.explode(F.sequence(
        F.floor((label["cy"] - reach) / BAND).cast("int"), F.floor((label["cy"] + reach) / BAND).cast("int"))))
    right = words.select("doc_id", "page", *[F.col(c).alias(f"w_{c}") for c in word]).withColumn(
        "band", F.floor(word["cy"] / BAND).cast("int"))
    met = left.join(right, ["doc_id", "page", "band"]).drop("band", "page")
    if positive:
        met = met.filter(F.abs(word["cx"] - label["cx"]) <= geo.width_of_reach(label, word))
    return met, label, word


def label_word_relation(labels: DataFrame, words: DataFrame, positive: bool = True) -> DataFrame:
    """(doc_id, label_id, word_idx, score, relation, l, w) of the words in a label's reach.

    With `positive`, words that score 0 or less - they can never be chosen - are left out.
    """
    met, label, word = _in_reach(labels, words, positive)
    # inline keeps the test on the score out of the join condition, where it would be
    # worked out for every pair of a band instead of the few in reach
    rated = met.select("*", F.inline(F.array(geo.relation_score(label, word))))
    if positive:
        rated = rated.filter("score > 0")
    l, w = (F.struct(*[x.alias(c) for c, x in side.items()]) for side in (label, word))
    return rated.select("doc_id", "label_id", word["word_idx"].alias("word_idx"), "score", "relation", l.alias("l"), w.alias("w"))


def best_value_per_label(labels: DataFrame, words: DataFrame, numeric_only: bool = False) -> DataFrame:
    """(doc_id, label_id, word_idx, score, relation, l, w): the word each label goes with."""
    usable = words.filter(F.rlike(F.col("text"), F.lit(r"(?U)\S")))
    if numeric_only:
        usable = usable.filter(F.rlike(F.col("text"), F.lit(r"(?U)\d")))
    pairs = label_word_relation(labels, usable).filter(
        ~geo.is_label_itself(F.col("l"), F.col("w")))
    return top_per(pairs, ["doc_id", "label_id"], [F.desc("score"), "word_idx"], 1).drop("rank")


# --- the vehicle number -------------------------------------------------------------------------
def vehicle_candidate_score(words: DataFrame, labels: DataFrame,
                            penalties: dict[str, float] = vocab.CLAIM_PENALTIES,
                            best: DataFrame | None = None) -> DataFrame:
    """(doc_id, word_idx, value, score, label, reason, page) of every 5 to 10 digit token.

    `best` is the numeric `best_value_per_label` of the labels, where it is known already.
    """
    if best is None:
        best = best_value_per_label(
            labels.filter(F.col("field").isin("vehicle_number", *penalties)), words, True)
    digits = normalize_registration(F.col("text"))
    tokens = words.withColumn("value", digits).filter(F.length("value").between(5, 10))
    plates = labels.filter("field = 'vehicle_number'")
    chosen = best.filter(F.col("l.field").isin("vehicle_number", *penalties) & (F.col("score") >= 45))
    values = chosen.filter("l.field = 'vehicle_number'").select("doc_id", "word_idx").distinct().withColumn(
        "is_value", F.lit(True))
    order = F.struct("l.field", F.bround(F.col("l.cy"), 0), -F.col("l.score"),
                     -(F.col("l.x1") - F.col("l.x0")), "label_id")
    claims = chosen.filter("l.field <> 'vehicle_number'").groupBy("doc_id", "word_idx").agg(
        F.max_by("l.field", order).alias("claimed"))
    near = label_word_relation(plates, tokens, positive=False).groupBy("doc_id", "word_idx").agg(
        F.max("score").alias("best"), F.count(F.lit(1)).alias("reached"),
        F.max_by("l.text", F.struct("score", -F.bround(F.col("l.cy"), 0))).alias("near_text"))
    count = plates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("plate_labels"))
    joined = tokens
    for side, keys in ((values, ["doc_id", "word_idx"]), (claims, ["doc_id", "word_idx"]),
                       (near, ["doc_id", "word_idx"]), (count, ["doc_id"])):
        joined = joined.join(side, keys, "left")
    # labels out of reach, or on another page, score 0
    assoc = F.when(F.coalesce("reached", F.lit(0)) < F.col("plate_labels"),
                   F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("best"))
    is_value = F.coalesce("is_value", F.lit(False))
    any_label = F.col("plate_labels").isNotNull()
    close = ~is_value & any_label & (assoc >= 50)
    shape = token_shape_flags(F.col("text"))
    size = F.length("value")
    penalty = F.coalesce(*[F.when(F.col("claimed") == f, p) for f, p in penalties.items()], F.lit(0.0))
    base = F.when(is_value, 100.0).when(any_label, F.least(assoc, F.lit(60.0)) * 0.5).otherwise(0.0)
    score = base + F.when(size.isin(7, 8), 50.0).otherwise(0.0) + penalty
    reasons = [
        F.when(is_value, "value of vehicle-registration label").when(close, "near vehicle-registration label"),
        F.when(size.isin(7, 8), F.concat(size, F.lit("-digit number"))),
        F.when(F.col("claimed").isNotNull(), F.concat(F.lit("value of "), F.col("claimed"))),
    ]
    for name, points in (("phone", 80.0), ("year", 50.0), ("money", 50.0), ("date", 50.0)):
        score = score - F.when(shape[name], points).otherwise(0.0)
        reasons.append(F.when(shape[name], f"looks like {name}"))
    reason = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return joined.select(
        "doc_id", "word_idx", "value", score.alias("score"),
        F.coalesce(F.when(is_value | close, F.col("near_text")), F.col("claimed")).alias("label"),
        F.when(reason == "", "numeric token").otherwise(reason).alias("reason"), "page")


def best_candidate_by_value(candidates: DataFrame) -> DataFrame:
    """Best scored token per distinct value of a document; `selected` marks the one to use.

    `first_idx` is where the value is first seen; it settles equal scores.
    """
    best = candidates.groupBy("doc_id", "value").agg(
        F.min("word_idx").alias("first_idx"),
        F.min_by(F.struct("word_idx", "score", "label", "reason", "page"),
                 F.struct(-F.col("score"), "word_idx")).alias("c"))
    top = best.groupBy("doc_id").agg(
        F.min_by("value", F.struct(-F.col("c.score"), "first_idx")).alias("top_value"))
    chosen = (
        (F.col("value") == F.col("top_value")) & (F.col("c.score") >= 60) & F.length("value").isin(7, 8)
    )
    return best.join(top, "doc_id").select("doc_id", "value", "c.*", "first_idx", chosen.alias("selected"))


# --- other fields -------------------------------------------------------------------------------
def _resolved(best: DataFrame, value: Column, source: Column | None = None) -> DataFrame:
    word, label = F.col("w"), F.col("l")
    if source is None:
        source = F.when(word["source"] == "pdf_text", "pdf_text_layout").otherwise(word["source"])
    return best.select(
        "doc_id", "label_id", label["field"].alias("field"), value.alias("value"),
        relation_confidence(F.col("score"), label["score"], word["conf"]).alias("confidence"),
        source.alias("source"), word["page"].alias("page"), label["text"].alias("label"),
        F.concat(F.col("relation"), F.lit(" label '"), label["text"], F.lit("'")).alias("reason"),
        label["score"].alias("label_score"),
    ).filter(F.coalesce("value", F.lit("")) != "")


def numeric_values(best: DataFrame) -> DataFrame:
    """The digits of each chosen value."""
    text = F.col("w.text")
    digits = normalize_registration(text)
    return _resolved(best, F.when(digits != "", digits).otherwise(F.trim(text)))


def raw_values(best: DataFrame) -> DataFrame:
    """Each chosen value as written."""
    return _resolved(best, F.regexp_replace("w.text", VALUE_ENDS, ""))


def resolve_numeric_field(labels: DataFrame, words: DataFrame) -> DataFrame:
    """The digits of each label's value."""
    return numeric_values(best_value_per_label(labels, words, True))


def resolve_raw_field(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Each label's value as written."""
    return raw_values(best_value_per_label(labels, words, True))


def resolve_date_field(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Each label's value as an ISO date."""
    return _resolved(best_value_per_label(labels, words),
                     parse_day_first(F.col("w.text")).cast("string"), F.lit("layout"))


def resolve_text_field(labels: DataFrame, rows: DataFrame, anchors: dict[str, list[str]] = vocab.ANCHORS) -> DataFrame:
    """Names and other texts of several words.

    Taken from the nearest row below in the label's column, else from the left of the
    label's row, else from its right, else the best single word; words that are labels
    themselves are left out. Words are joined from right to left. The nearest row below
    may be any distance away, so a label meets all rows of its page here, each as one record;
    what is found is two row numbers per label, and only those rows are opened up.
    """
    names = settle(match_label(rows.select(F.col("text").alias("phrase")), anchors).select(
        F.col("phrase").alias("text"), F.lit(True).alias("is_label")))
    labels = geo.with_center(labels)
    left = labels.select("doc_id", "page", "label_id", _as_box(labels, "l"))
    own_words = F.struct("word_idx", "text", *BOX, "conf", "source", "is_label")
    # words move once, by page; rows, labels and the rows picked for them stay in that order
    packed = rows.join(left.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").join(
        names, "text", "left").groupBy("doc_id", "page", "row_id").agg(
        F.min((F.col("y0") + F.col("y1")) / 2).alias("row_top"),
        F.collect_list(F.when(F.rlike(F.col("text"), F.lit(r"(?U)\S")), own_words)).alias("ws"))
    packed = settle_by(packed, "doc_id")  # read once to pick rows, once to open them
    label, word = F.col("l"), F.col("w")
    high, y = geo.height(label), label["cy"]

    def is_below(w: Column) -> Column:
        return (
            w["is_label"].isNull() & (w["x1"] >= label["x0"] - high)
            & (w["x0"] <= label["x1"] + high) & F.rlike(w["text"], F.lit(r"\p{L}")))

    lower = F.col("row_top") > label["y1"] - high * 0.3
    met = left.join(packed, ["doc_id", "page"])
    at = F.struct("row_top", "row_id")
    pick = settle(met.select(
        "doc_id", "label_id", F.when(lower & F.exists("ws", is_below), at).alias("under"),
        F.when(F.exists("ws", lambda w: F.abs((w["y0"] + w["y1"]) / 2 - y) <= high * 0.6), F.col("row_id")).alias("beside"),
    ).filter("under is not null or beside is not null").groupBy("doc_id", "label_id").agg(
        F.min("under").alias("under"), F.min("beside").alias("beside")), in_place=True)
    targets = left.join(pick, ["doc_id", "label_id"]).withColumn(
        "row_id", F.explode(F.array_distinct(F.array_compact(F.array("under.row_id", "beside")))))
    cx, cy = (word["x0"] + word["x1"]) / 2, (word["y0"] + word["y1"]) / 2
    own = cx.between(label["x0"] - 1, label["x1"] + 1) & cy.between(label["y0"] - 1, label["y1"] + 1)
    free = word["is_label"].isNull()
    place = (
        F.when(lower & is_below(word) & (F.col("row_id") == F.col("under.row_id")), 0)
        .when((F.col("row_id") == F.col("beside")) & free & (word["x1"] <= label["x0"] + 1) & ~own, 1)
        .when((F.col("row_id") == F.col("beside")) & free & (word["x0"] >= label["x1"] - 1), 2)
    )
    near = settle(targets.join(packed, ["doc_id", "page", "row_id"]).withColumn("w", F.explode("ws")).select(
        "doc_id", "label_id", "l", "w", place.alias("place")).filter("place is not null"), in_place=True)
    rows = geo.with_center(rows)
    lone = settle(best_value_per_label(labels, rows), in_place=True).select(
        "doc_id", "label_id", "l", F.col("w.text").alias("text"), F.col("w.x0").alias("x0"),
        F.col("w.conf").alias("conf"), F.col("w.source").alias("source"),
        F.col("w.word_idx").alias("word_idx"), F.lit(3).alias("place"))
    tokens = near.select(
        "doc_id", "label_id", "l", "w.text", "w.x0", "w.conf", "w.source", "w.word_idx", "place"
    ).unionByName(lone)
    grouped = tokens.groupBy("doc_id", "label_id", "place").agg(
        F.first("l").alias("l"), F.min("conf").alias("conf"),
        F.array_sort(F.collect_list(F.struct((-F.col("x0")).alias("at"), "word_idx", "text", "source"))).alias("parts"))
    best = top_per(grouped, ["doc_id", "label_id"], ["place"], 1)
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), " "), VALUE_ENDS, "")
    first_source = F.get("parts", F.lit(0))["source"]
    return best.select(
        "doc_id", "label_id", F.col("l.field").alias("field"), text.alias("value"),
        F.least(F.lit(0.92), 0.85 * F.col("l.score") * F.col("conf")).alias("confidence"),
        F.when(first_source == "pdf_text", "pdf_text_layout").otherwise(first_source).alias("source"),
        F.col("l.page").alias("page"), F.col("l.text").alias("label"), F.lit("text near label").alias("reason"),
        F.col("l.score").alias("label_score"),
    ).filter((F.length("value") >= 2) & F.rlike(F.col("value"), F.lit(r"\p{L}")))


def first_resolved_field(resolved: DataFrame) -> DataFrame:
    """Per document and field the value of the best label, longer label text first on a tie."""
    order = [F.desc("label_score"), F.desc(F.length("label")), "label_id"]
    return top_per(resolved, ["doc_id", "field"], order, 1).drop("rank", "label_id", "label_score")


def chosen_vehicle_number(best: DataFrame) -> DataFrame:
    """The selected candidate of a document as a field."""
    return best.filter("selected").select(
        "doc_id", F.lit("vehicle_number").alias("field"), "value",
        candidate_confidence(F.col("score")).alias("confidence"), F.lit("pdf_text_layout").alias("source"),
        "page", "label", "reason")
