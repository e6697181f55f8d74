"""Fuzzy text comparison: Indel ratio, near-copies among retrieved chunks, answers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import normalize_ws, sentences_of


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per bit row."""
    if len(a) > len(b):
        a, b = b, a
    return len(a) - open_bits_of(a, b).bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common subsequence / total length; 1 for two empty texts."""
    total = len(a) + len(b)
    return 1.0 if total == 0 else 2.0 * common_length(a, b) / total


def open_bits_of(a: str, b: str) -> int:
    """Bits over a; so many of the first j are 0 as a[:j] and b have in common."""
    where: dict[str, int] = {}
    if len(a) < 256:
        for i, ch in enumerate(a):
            where[ch] = where.get(ch, 0) | (1 << i)
    else:  # a mask per letter, not a wide number per place
        points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
        for ch in set(a):
            where[ch] = int.from_bytes(np.packbits(points == ord(ch), bitorder="little").tobytes(), "little")
    full = open_bits = (1 << len(a)) - 1
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return open_bits


def starts_too_differently(a: str, b: str, threshold: float) -> bool:
    """Whether the beginnings alone need more edits than the threshold leaves room for.

    A start of b goes with some start of a, of which it can differ in length by no more than the
    room left, and the rest costs at least its difference in length. So a yes is final; a no says nothing.
    """
    room = (1 - threshold) * (len(a) + len(b)) + 1e-6
    size = int(1.25 * room) + 32
    if len(a) + len(b) < 200 or size > 0.7 * min(len(a), len(b)):
        return False
    low = max(0, math.ceil(size + (len(a) - len(b) - room) / 2))
    high = min(len(a), math.floor(size + (len(a) - len(b) + room) / 2))
    if high < low:
        return True
    bits = open_bits_of(a[:high], b[:size])
    zeros = 1 - np.unpackbits(np.frombuffer(bits.to_bytes(high // 8 + 1, "little"), np.uint8), bitorder="little")[:high].astype(np.int64)
    common = np.concatenate([[0], np.cumsum(zeros)])
    j = np.arange(low, high + 1)
    edits = size + j - 2 * common[low: high + 1] + np.abs((len(b) - size) - (len(a) - j))
    return bool(edits.min() > room)


def at_least(a: str, b: str, threshold: float) -> bool:
    """ratio(a, b) >= threshold, without the costly part when lengths or beginnings rule it out."""
    total = len(a) + len(b)
    if total and 2.0 * min(len(a), len(b)) / total < threshold or starts_too_differently(a, b, threshold):
        return False
    return ratio(a, b) >= threshold


def text_similarity(a: Column, b: Column) -> Column:
    """Indel ratio of two text columns (Arrow batches)."""
    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([
            None if p is None or q is None else ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return similarity(a, b)


def dedupe_similar_chunks(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Keep, best score first, the chunks of a question unlike all kept before.

    A chunk goes when its normalized text lies in a kept one, contains one, or is at
    least `threshold` similar. Input columns: query_id, chunk_id, rank, score, content.
    A question has at most twice the retrieval limit of chunks, so its texts are put
    into one short array and compared in Arrow batches.
    """
    text = F.lower(normalize_ws(F.col("content")))
    lists = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("neg"), "rank", "chunk_id", text.alias("text")))).alias("items"))

    @F.pandas_udf("array<boolean>")
    def keep(texts: pd.Series) -> pd.Series:
        def decide(group) -> list[bool]:
            kept: list[str] = []
            out = []
            for t in group:
                copy = any(
                    t and k and (t in k or k in t or at_least(t, k, threshold)) for k in kept)
                if not copy:
                    kept.append(t)
                out.append(not copy)
            return out

        return texts.map(decide)

    flagged = lists.withColumn("keep", keep(F.transform("items", lambda i: i["text"])))
    kept = flagged.select(
        "query_id", F.explode(F.arrays_zip(F.col("items.chunk_id").alias("chunk_id"), "keep")).alias("z")
    ).select("query_id", "z.chunk_id", "z.keep").filter("keep").drop("keep")
    return chunks.join(kept, ["query_id", "chunk_id"], "left_semi")


def clean_answer(col: Column, threshold: float = 0.9) -> Column:
    """Answer without scaffolding, marks and sentences that repeat an earlier one."""
    @F.pandas_udf("array<boolean>")
    def fresh(groups: pd.Series) -> pd.Series:
        def decide(sentences) -> list[bool]:
            seen: list[str] = []
            out = []
            for s in sentences:
                again = any(s == k or at_least(s, k, threshold) for k in seen)
                if not again:
                    seen.append(s)
                out.append(not again)
            return out

        return groups.map(decide)

    sentences = sentences_of(col)
    folded = F.transform(sentences, lambda s: F.lower(normalize_ws(s)))
    flags = F.zip_with(sentences, fresh(folded), lambda s, keep: F.when(keep, s))
    return normalize_ws(F.array_join(F.array_compact(flags), " "))
