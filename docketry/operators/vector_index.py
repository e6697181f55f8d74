"""A growing index of vectors in cells around pivots, and exact nearest neighbours from it.

Building takes a bounded sample of rows as pivots and writes every row once, into the cell of its
nearest pivot; a cell's radius is the largest angle to its pivot. Appending assigns new rows to
the same pivots and widens the radii. The rows never move again: they are read in place, only the
cells that are needed, and questions travel to them.

A question at angle a from a pivot can score no more than cos(a - radius) in its cell. Each question
first reads its nearest cells, which gives a k-th score to beat, and then every other cell whose
bound reaches that score: all of these, so the result is exact. How many cells that is depends on
the vectors; `read` tells.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.session import settle, shared_folder

PIVOTS = 256  # at most
CELL_ROWS = 4096  # a smaller index has fewer pivots, so that a cell is worth reading apart
ROWS_AT_ONCE = 4096  # index rows that meet a batch of questions
QUESTIONS_AT_ONCE = 2048
SLACK = 1e-7  # for rounding in angles and scores


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as rows of length one; rows of zeros stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


@dataclass
class VectorIndex:
    """Rows (with a column `vector`) in cells; `radii` has one row per cell and append."""

    folder: str
    schema: object
    pivots: np.ndarray

    @classmethod
    def build(cls, rows: DataFrame, pivots: int | None = None, folder: str | None = None) -> VectorIndex:
        """Write `rows` as an index below `folder`; rows with an empty or NULL vector are left out.

        Pivots are at most `pivots` rows, taken in the order of a hash of the vector; without
        a number there is one for every CELL_ROWS rows, up to PIVOTS.
        """
        spark = rows.sparkSession
        folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        rows = rows.filter(F.size("vector") > 0)
        pivots = pivots or min(PIVOTS, 1 + rows.count() // CELL_ROWS)
        sample = rows.select("vector").orderBy(F.xxhash64("vector")).limit(pivots).toArrow()["vector"]
        index = cls(folder, rows.schema, unit_rows(sample) if len(sample) else np.zeros((0, 0)))
        index.append(rows)
        return index

    def append(self, rows: DataFrame) -> None:
        """Add rows of the same columns. A repeated append adds its rows again."""
        if not len(self.pivots):
            return
        pivots = self.pivots
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    cosines = unit_rows(batch["vector"]) @ pivots.T
                    cell = cosines.argmax(1)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(_angles(cosines[np.arange(len(cell)), cell]))],
                        names=[*batch.schema.names, "cell", "angle"])

        placed = rows.filter(F.size("vector") > 0).select(*self.schema.names).mapInArrow(run, f"{fields}, cell int, angle double")
        part = f"{self.folder}/rows/part={uuid.uuid4().hex}"
        placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.partitionBy("cell").parquet(part)
        spark = rows.sparkSession
        found = spark.read.schema(f"{fields}, angle double, cell int").parquet(part).groupBy("cell").agg(
            F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).toArrow()  # a row per pivot at most
        spark.createDataFrame(found).coalesce(1).write.mode("append").parquet(f"{self.folder}/radii")

    def rows(self, spark: SparkSession) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return spark.read.schema(f"{fields}, part string, cell int").parquet(f"{self.folder}/rows")

    def cells(self, spark: SparkSession) -> dict[int, float]:
        """Radius by cell; as many as there are pivots at most."""
        if not len(self.pivots):
            return {}
        made = spark.read.parquet(f"{self.folder}/radii").groupBy("cell").agg(F.max("radius").alias("radius")).collect()
        return {r["cell"]: r["radius"] for r in made}


def _wanted(questions: DataFrame, index: VectorIndex, radii: dict[int, float], nearest: int, rest: bool) -> DataFrame:
    """questions with `cell`: each one's nearest cells, or the others whose bound reaches its `beat`."""
    cells = np.array(sorted(radii), np.int64)
    radius = np.array([radii[c] for c in cells.tolist()])
    pivots = index.pivots[cells]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            angles = _angles(unit_rows(batch["vector"]) @ pivots.T)
            bound = np.cos(np.maximum(angles - radius, 0.0)) + SLACK
            order = np.argsort(-bound, axis=1, kind="stable")
            near = np.zeros(bound.shape, bool)
            np.put_along_axis(near, order[:, :nearest], True, axis=1)
            if rest:
                beat = batch["beat"].to_numpy(zero_copy_only=False).astype(float)
                near = ~near & ~(bound < np.where(np.isnan(beat), -np.inf, beat)[:, None])
            row, at = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns), pa.array(cells[at].astype(np.int32))],
                names=[*batch.schema.names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return questions.mapInArrow(run, f"{fields}, cell int")


def _scan(spark: SparkSession, index: VectorIndex, wanted: DataFrame, columns: list[str], schema: str,
          ranker: Callable) -> DataFrame:
    """What `ranker(questions)` finds in the cells that `wanted` names; index rows are read in place.

    Questions are written by cell; a task reads those of its cell in batches, for some thousand
    index rows at a time.
    """
    folder = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    wanted.hint("rebalance", "cell").write.partitionBy("cell").parquet(folder)
    needed = [r["cell"] for r in spark.read.schema(wanted.schema).parquet(folder).select("cell").distinct().collect()]
    if not needed:
        return spark.createDataFrame([], schema)
    rows = index.rows(spark).filter(F.col("cell").isin(needed)).select(*columns, "vector", "cell")
    return rows.mapInArrow(_meeting(lambda cell: f"{folder}/cell={cell}", ranker), schema)


def _meeting(asked_in: Callable[[int], str | list[str]], ranker: Callable) -> Callable:
    """A task's work: each cell's rows with the questions that lie in `asked_in(cell)`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            cell = batch["cell"].to_numpy()
            for c in np.unique(cell).tolist():
                mine = batch.filter(pa.array(cell == c))
                places = asked_in(c)
                store = fs.FileSystem.from_uri(places if isinstance(places, str) else places[0])[0]
                paths = [fs.FileSystem.from_uri(p)[1] for p in ([places] if isinstance(places, str) else places)]
                asked = ds.dataset(paths if len(paths) > 1 else paths[0], filesystem=store, format="parquet")
                for start in range(0, len(mine), ROWS_AT_ONCE):
                    rows = mine.slice(start, ROWS_AT_ONCE)
                    for questions in asked.to_batches(batch_size=QUESTIONS_AT_ONCE):
                        if len(questions):
                            yield from ranker(questions, rows)

    return run


def search(questions: DataFrame, index: VectorIndex, columns: list[str], schema: str, ranker: Callable,
           kth: Callable[[DataFrame], DataFrame], nearest: int = 2) -> tuple[DataFrame, DataFrame]:
    """(found, read): what the ranker finds in all cells that matter; (query_id, cells_read, cells).

    `questions` is a table read from files (`settle`).
    `ranker(questions, rows)` yields record batches of `schema` for a batch of each; `kth(found)`
    gives (query_id, beat): the score that further rows must reach, for questions that have k.
    """
    spark = questions.sparkSession
    radii = index.cells(spark)
    if not radii:
        empty = questions.select("query_id", F.lit(0).cast("long").alias("cells_read"), F.lit(0).cast("long").alias("cells"))
        return spark.createDataFrame([], schema), empty
    if nearest >= len(radii):  # all questions meet all rows, in batches
        read = questions.select("query_id", *[F.lit(len(radii)).cast("long").alias(c) for c in ("cells_read", "cells")])
        files = sorted(questions.inputFiles())
        if not files:
            return spark.createDataFrame([], schema), read
        return index.rows(spark).select(*columns, "vector", "cell").mapInArrow(_meeting(lambda cell: files, ranker), schema), read
    near = _wanted(questions, index, radii, nearest, rest=False)
    first = settle(_scan(spark, index, near, columns, schema, ranker))
    left = questions.join(kth(first), "query_id", "left")
    far = settle(_wanted(left, index, radii, nearest, rest=True).drop("beat"))
    found = first.unionByName(_scan(spark, index, far, columns, schema, ranker))
    read = questions.select("query_id").join(far.groupBy("query_id").agg(F.count(F.lit(1)).alias("more")), "query_id", "left").select(
        "query_id", (F.lit(min(nearest, len(radii))) + F.coalesce("more", F.lit(0))).cast("long").alias("cells_read"),
        F.lit(len(radii)).cast("long").alias("cells"))
    return found, read
