"""Substring search of many needles in many texts, by postings of character grams.

A needle is looked up by its rarest grams of eight characters, a shorter one by its trigrams, one
shorter than three characters whole. Texts give one posting (gram, text) for each of these that
they hold, and no other; a text that has all of a needle's grams is a candidate and is
compared. How rare a gram is comes from a bounded sample of the texts: it decides the work,
never the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.grams import TABLE, U64, from_texts, grams, points, rare_first, slot

GRAMS = 2  # looked up per needle
LONG, SHORT = 8, 3  # characters of a gram
SAMPLE_ROWS = 500  # texts from which the rarity of grams is estimated
EMPTY = 1  # the posting of every text, for needles that fit all


def literal_runs(needle: str, wildcards: bool) -> list[str]:
    """The parts of a needle that any text it fits must hold."""
    return [r for r in re.split(r"\\.|[%_]", needle) if r] if wildcards else [needle]


def _keys(needle: str, counts: np.ndarray, wildcards: bool) -> np.ndarray:
    """The grams a needle is looked up by."""
    runs = [points(r) for r in literal_runs(needle, wildcards)]
    for q in (LONG, SHORT):
        some = [grams(r, q) for r in runs if len(r) >= q]
        if some:
            return rare_first(np.unique(np.concatenate(some)), counts)[:GRAMS]
    whole = [grams(r, len(r)) for r in runs if len(r)]
    return np.unique(np.concatenate(whole)) if whole else np.array([EMPTY], U64)


def sampled_counts(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """How often the grams of each slot stand in at most `sample_rows` texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TABLE, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = points(text)
                seen += np.bincount(slot(np.concatenate([grams(own, LONG), grams(own, SHORT)])), minlength=TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()])], names=["seen"])

    made = texts.select("text").limit(sample_rows).mapInArrow(run, "seen binary").toArrow()["seen"]
    return sum((np.frombuffer(x, np.int64) for x in made.to_pylist()), np.zeros(TABLE, np.int64))


def candidates(texts: DataFrame, needles: DataFrame, wildcards: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(needle_id, text_id) of texts that hold all looked-up grams of a needle.

    texts(text_id, text), needles(needle_id, text), none NULL. Every text that a needle stands in,
    or that fits it as a pattern, is among them.
    """
    counts = sampled_counts(texts, sample_rows)
    kind = dict(needles.dtypes)["needle_id"]

    def look_ups(text: str) -> dict:
        h = _keys(text, counts, wildcards)
        return {"gram": h.view(np.int64), "n": np.full(len(h), len(h))}

    asked = from_texts(needles.select("needle_id", "text"), f"needle_id {kind}, gram long, n long", look_ups)

    def marks(text: str) -> dict:
        h = _keys(text, counts, wildcards)
        longest = max(map(len, literal_runs(text, wildcards)), default=0)
        # the size of the grams, -1 for whole short runs, 0 for none
        size = LONG if longest >= LONG else SHORT if longest >= SHORT else -1 if longest else 0
        return {"slot": slot(h), "q": np.full(len(h), size)}

    # which slots anybody looks for, and gram sizes: a table of fixed size
    found = from_texts(needles.select("text"), "slot long, q long", marks).distinct().toArrow()
    wanted = np.zeros(TABLE, bool)
    wanted[found["slot"].to_numpy()] = True
    kinds = set(found["q"].to_pylist())
    sizes = [q for q in (LONG, SHORT) if q in kinds] + ([1, 2] if -1 in kinds else [])

    def postings(text: str) -> dict:
        own = points(text)
        h = np.concatenate([np.zeros(0, U64), *(grams(own, q) for q in sizes)])
        h = np.unique(h[wanted[slot(h)]])
        return {"gram": (np.append(h, U64(EMPTY)) if 0 in kinds else h).view(np.int64)}

    text_kind = dict(texts.dtypes)["text_id"]
    held = from_texts(texts.select("text_id", "text"), f"text_id {text_kind}, gram long", postings)
    return held.join(asked, "gram").groupBy("needle_id", "text_id").agg(
        F.count(F.lit(1)).alias("have"), F.first("n").alias("n")).filter("have = n").select("needle_id", "text_id")
