"""Hashes of short runs of characters, for candidate search in texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TABLE = 1 << 18  # slots of tables by gram hash; a fixed size, whatever the texts
U64 = np.uint64
_ODD = np.array([(2 * i * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93) & (1 << 64) - 1 for i in range(16)], U64) | U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)


def grams(of: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q code points."""
    n = len(of) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        each = mixed(of + U64(1))  # once per code point, not once per run that it stands in
        total = np.full(n, U64(q), U64)
        for k in range(q):
            total += each[k: k + n] * _ODD[k]
    return mixed(total)


def numbered(h: np.ndarray) -> np.ndarray:
    """Equal hashes made different: the first, second, ... of its kind in the text."""
    h = np.sort(h)
    nth = np.arange(len(h)) - np.searchsorted(h, h)
    with np.errstate(over="ignore"):
        return mixed(h + nth.astype(U64) * _ODD[9])


def slot(h: np.ndarray) -> np.ndarray:
    """The slot of a hash in a table of TABLE slots."""
    return (h >> U64(40)).astype(np.int64) & (TABLE - 1)


def rare_first(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes by the count of their slot, ties by hash: the same order everywhere."""
    return h[np.lexsort((h, counts[slot(h)]))]


def from_texts(df: DataFrame, schema: str, of_text: Callable[[str], dict]) -> DataFrame:
    """Rows made from the column `text`, with the columns of `schema` that stand beside it."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = [n for n in batch.schema.names if n in names]
            parts, rows = {n: [] for n in names if n not in beside}, []
            for row, text in enumerate(batch["text"]):
                made = of_text(text.as_py())
                for n, x in made.items():
                    parts[n].append(x)
                rows.append(np.full(len(next(iter(made.values()))), row))
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            if len(at):
                columns = {n: batch[n].take(pa.array(at)) for n in beside} | {n: pa.array(np.concatenate(x)) for n, x in parts.items()}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return df.mapInArrow(run, schema)
