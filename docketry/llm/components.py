"""Connected components of a table of links, by large-star and small-star steps.

Every step is a minimum over sorted neighbours; links are contracted inside their partitions
first (a union-find over one partition), so the steps run on few rows. Nothing goes to the
driver but a count and a checksum per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.tables import settle


def _contracted(links: DataFrame) -> DataFrame:
    """Per partition: each node linked to the smallest node it is connected with there."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    return links.select("u", "v").mapInArrow(contract, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v; edges may be repeated.

    A node's neighbours are read in order, so that the smallest of them is the first: one
    shuffle and one sort, and no group is held in memory.
    """
    along = Window.partitionBy("u").orderBy("v")
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.withColumn("m", F.least(F.first("v").over(along), "u")).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
    low = edges.withColumn("m", F.first("v").over(along))
    return low.select(F.inline(F.array(
        F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    ).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component of every linked node: the smallest node it is connected with.

    `links` has columns u and v (long). A smallest node itself is not listed unless linked
    to a smaller one; callers take a missing node as its own component.
    """
    edges = settle(_contracted(links))
    seen = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if sums["n"] == 0 or sums == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = sums
        edges = settle(_star(_star(edges, large=True), large=False))
