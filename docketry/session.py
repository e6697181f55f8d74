"""Session defaults and the few helpers that depend on cluster settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Spark 4.1 may report a union as hash-partitioned although its parts were coalesced
# apart, and a later join then fails ("Can't zip RDDs with unequal numbers of
# partitions"). Unions here do not rely on that report.
UNION_PARTITIONING = ("spark.sql.unionOutputPartitioning", "false")


def build_session(app: str = "docketry", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        UNION_PARTITIONING[0]: UNION_PARTITIONING[1],
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    A session on this machine alone that names none, as in tests, gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        folder = os.path.join(tempfile.gettempdir(), f"docketry-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """While it is open, a join by a key and more leaves a side that lies by the key where it is."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame, in_place: bool = False) -> DataFrame:
    """Write an intermediate result once to the shared folder and go on from the table.

    For results that several later steps read: they are computed once, outlive lost
    executors, and have a known size when the next joins are planned. With `in_place`,
    tables of `settle_by` are joined where they lie, also by their key and more.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    with _in_place(df.sparkSession) if in_place else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lies_by(df: DataFrame, key: str) -> bool:
    """Whether rows of a key are together already: a count by the key needs no exchange of its own."""
    with _in_place(df.sparkSession):
        node = df.groupBy(key).count()._jdf.queryExecution().executedPlan()
    node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    while re.search("Aggregate|Project|Sort$", node.nodeName()):
        node = node.children().head()
    return "ENSURE_REQUIREMENTS" not in node.toString().split("\n")[0]


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """`settle`, with the rows of a key in one bucket: what groups or joins by the key, or is settled
    `in_place`, reads them without a shuffle.

    Rows that lie so already are not shuffled here either. As many buckets as the session has
    shuffle partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not _lies_by(df, key):
        df = df.repartition(parts, key)
    name = f"settled_{uuid.uuid4().hex}"
    with _in_place(spark):
        df.write.format("parquet").option("compression", "zstd").bucketBy(parts, key).option(
            "path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.read.table(name)
    spark.sql(f"drop table {name}")  # from the catalog; the files stay
    return table


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table; its size is the length of a constant list."""
    return spark.createDataFrame(rows, schema)
