"""Streaming jobs run to their end over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.checks.base import Data, query
from docketry.session import shared_folder
from docketry.streaming import jobs


def folder(d: Data, name: str) -> str:
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(d: Data, df, name: str, parts: int = 2):
    """The rows of df as a stream that arrives in a few files."""
    path = folder(d, name)
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return d.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_ingest_dedupe", "select distinct content_hash from docs")
def _(d: Data):
    uploads = d.docs.select("document_id", "content_hash",
                            F.timestamp_seconds(F.lit(1.7e9) + F.col("arrival")).alias("arrived_at"))
    table = folder(d, "uploads")
    jobs.stream_ingest_dedupe(as_stream(d, uploads, "incoming"), table, checkpoint=folder(d, "cp")).awaitTermination()
    return d.spark.read.parquet(table).select("content_hash")


def usage(d: Data):
    return d.usage.withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("stream_usage_windows", """
select strftime(date_trunc('day', created_at), '%Y-%m-%d') as day, count(*) as calls,
  cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
  count(*) filter (success) as successful from usage group by 1""")
def _(d: Data):
    table = folder(d, "windows")
    jobs.stream_usage_windows(as_stream(d, usage(d), "usage", 1), table, checkpoint=folder(d, "cp"), open_too=True).awaitTermination()
    return jobs.current_windows(d.spark, table).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "calls", "input_tokens", "output_tokens", "successful")


#: the first half of a month's rows arrives after all others: what is late is what had ended by then
@query("stream_late_rows", """
select strftime(date_trunc('day', created_at), '%Y-%m-%d') as day, count(*) as n from usage
where user_id % 2 = 0 and date_trunc('day', created_at) + interval 1 day
  <= (select max(created_at) - interval 1 hour from usage where user_id % 2 = 1) group by 1""")
def _(d: Data):
    path, table = folder(d, "usage"), folder(d, "late")
    for odd in (1, 0):  # two files, taken one after the other
        usage(d).filter(F.col("user_id") % 2 == odd).coalesce(1).write.mode("append").parquet(path)
        stream = d.spark.readStream.schema(usage(d).schema).parquet(path)
        jobs.stream_late_rows(stream, table, checkpoint=f"{table}-cp").awaitTermination()
    return d.spark.read.schema(usage(d).schema).parquet(f"{table}/late").groupBy(
        F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_conflict_rescan", "select a_id, b_id, conflict_type from conflicts")
def _(d: Data):
    conflicts = folder(d, "conflicts")
    jobs.stream_conflict_rescan(as_stream(d, d.policies, "policies"), folder(d, "stored"), conflicts,
                                folder(d, "cp")).awaitTermination()
    return jobs.current_conflicts(d.spark, conflicts, jobs.conflict_schema(d.policies)).select("a_id", "b_id", "conflict_type")
