"""Text files as page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one page of UTF-8 text; bytes that are not UTF-8 are replaced.

    Extensions other than txt, md, csv and log are read the same way; csv is not parsed.
    Spark plans a small file like one of 4 MB, so very many of them would be very many tasks of a
    few files each; they are put together.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).coalesce(
        max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return files.select(
        "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
        F.lit(1).alias("page"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
