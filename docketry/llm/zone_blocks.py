"""Vectors as Parquet blocks along a Hilbert curve, with the least and greatest value of each dimension.

`write` sorts the rows by label and place on the curve and writes them as Parquet files whose
row groups are the blocks; `zones` has one row per block: its file, number, rows, smallest id,
labels and the range of every dimension. `Blocks` reads single blocks from a task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tables import scratch, settle

BLOCK_ROWS = 1024
FILE_BLOCKS = 8
BITS = 4  # of each dimension in the place on the curve
ROW = "vec_id long, label int, vector array<long>"
ZONE = ("file string, block int, n_rows long, first_id long, low_label int, high_label int, "
        "low array<long>, high array<long>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` numbers; shorter lists end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points in a grid of 2**bits cells a side, as bytes that sort alike.

    Each bit plane, from the top, turns the axes of the planes below it; what is left is the
    Gray code of the place, one bit per axis and plane.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        top, rest = 1 << plane, (1 << plane) - 1
        for k in range(n):
            set_ = (x[k] & top) != 0
            turn = np.where(set_, 0, (x[0] ^ x[k]) & rest)
            x[0] ^= np.where(set_, rest, turn)
            x[k] ^= turn if k else 0
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << plane), (1 << plane) - 1, 0)
    x ^= flip
    planes = np.concatenate([(x >> plane) & 1 for plane in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.T, axis=1)


@dataclass(frozen=True)
class Grid:
    """The range of each dimension over all rows, widest spread first in `order`."""

    low: np.ndarray
    high: np.ndarray
    order: np.ndarray
    rows: int

    @property
    def width(self) -> int:
        return len(self.low)

    def cells(self, vectors: np.ndarray, bits: int) -> np.ndarray:
        span = np.maximum(self.high - self.low, 1).astype(float)
        cell = (vectors - self.low) / span * (1 << bits)
        return np.clip(cell, 0, (1 << bits) - 1).astype(np.int64)[:, self.order]


def grid_of(rows: DataFrame) -> Grid:
    """One pass: ranges and variances per dimension, summed per batch, one row per dimension at the end."""
    out = "d int, n long, low double, high double, s double, q double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            width = int(lists.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) if len(lists) else 0
            v = matrix(lists, width).astype(float)
            d = np.arange(-1, width, dtype=np.int32)  # -1 counts the rows

            def of(x, none):
                return pa.array(np.append(none, x))

            yield pa.RecordBatch.from_arrays([
                pa.array(d), pa.array(np.full(width + 1, len(lists), np.int64)),
                of(v.min(0, initial=np.inf), 0.0), of(v.max(0, initial=-np.inf), 0.0), of(v.sum(0), 0.0),
                of((v * v).sum(0), 0.0)], names=["d", "n", "low", "high", "s", "q"])

    made = rows.select("vector").mapInArrow(run, out).groupBy("d").agg(
        *[f(c).alias(c) for f, c in ((F.sum, "n"), (F.min, "low"), (F.max, "high"), (F.sum, "s"), (F.sum, "q"))]).collect()
    total = sum(r["n"] for r in made if r["d"] < 0)
    by = sorted((r for r in made if r["d"] >= 0), key=lambda r: r["d"])
    spread = np.array([r["q"] - r["s"] ** 2 / max(total, 1) for r in by])
    return Grid(np.array([min(r["low"], 0.0) if r["n"] < total else r["low"] for r in by]),
                np.array([max(r["high"], 0.0) if r["n"] < total else r["high"] for r in by]),
                np.argsort(-spread, kind="stable"), total)


def placed(rows: DataFrame, grid: Grid, bits: int = BITS) -> DataFrame:
    """rows (vec_id, label, vector) with `place` on the curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = hilbert(grid.cells(matrix(batch.column(2), grid.width), bits), bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k.tobytes() for k in key], pa.binary())],
                names=["vec_id", "label", "vector", "place"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, ROW + ", place binary")


def write(rows: DataFrame, grid: Grid, block_rows: int = BLOCK_ROWS, bits: int = BITS) -> tuple[str, DataFrame]:
    """(folder of the blocks, zones): rows in the order of the curve, a row group per block."""
    spark = rows.sparkSession
    folder = scratch(spark, "blocks")
    files = max(1, -(-grid.rows // (block_rows * FILE_BLOCKS)))
    order = ["label", "place", "vec_id"]
    placed(rows, grid, bits).repartitionByRange(files, *order).sortWithinPartitions(*order).write.option(
        "parquet.block.row.count.limit", block_rows).parquet(folder)
    width = grid.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # file, block, rows, first id, labels, ranges so far

        def row(z) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(z, (
                pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()),
                pa.list_(pa.int64())), strict=True)], names=[f.split(" ")[0] for f in ZONE.split(", ")])

        for batch in batches:
            files_ = batch.column(0).to_pylist()
            number = batch.column(1).to_numpy() // block_rows
            ids, labels = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            v = matrix(batch.column(4), width)
            edges = [0, *(k for k in range(1, len(files_)) if number[k] != number[k - 1] or files_[k] != files_[k - 1]), len(files_)]
            for a, b in zip(edges, edges[1:]):
                new = (files_[a].rsplit("/", 1)[1], int(number[a]), b - a, int(ids[a:b].min()), int(labels[a:b].min()),
                       int(labels[a:b].max()), v[a:b].min(0), v[a:b].max(0))
                if held and held[:2] == new[:2]:
                    held = (*new[:2], held[2] + new[2], min(held[3], new[3]), min(held[4], new[4]), max(held[5], new[5]),
                            np.minimum(held[6], new[6]), np.maximum(held[7], new[7]))
                else:
                    if held:
                        yield row(held)
                    held = new
        if held:
            yield row(held)

    written = spark.read.schema(ROW).parquet(folder)
    return folder, settle(written.select(
        "_metadata.file_path", "_metadata.row_index", "vec_id", "label", "vector").mapInArrow(run, ZONE))


class Blocks:
    """Reads zones as a stream and single blocks, from a task; a few blocks stay in memory."""

    def __init__(self, folder: str, zones: list[str], width: int, kept: int = 64):
        from pyarrow import fs

        self.store, self.top = fs.FileSystem.from_uri(folder)
        self.zone_files, self.width, self.kept = zones, width, kept
        self.files: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()

    def zones(self, at_once: int = 4096) -> Iterator[dict[str, np.ndarray]]:
        """The zones, some thousand blocks at a time."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        for uri in self.zone_files:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=at_once):
                    if len(batch):
                        out = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (
                            "file", "block", "first_id", "low_label", "high_label")}
                        yield out | {n: matrix(batch.column(n), self.width) for n in ("low", "high")}

    def read(self, name: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, labels, vectors) of a block."""
        import pyarrow.parquet as pq

        key = (name, int(block))
        if key not in self.blocks:
            if name not in self.files:
                self.files[name] = pq.ParquetFile(self.store.open_input_file(f"{self.top}/{name}"))
                if len(self.files) > 8:
                    self.files.popitem(last=False)[1].close(force=True)
            got = self.files[name].read_row_group(key[1], columns=["vec_id", "label", "vector"])
            self.blocks[key] = (got["vec_id"].to_numpy(), got["label"].to_numpy(), matrix(got["vector"], self.width))
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(key)
        return self.blocks[key]
