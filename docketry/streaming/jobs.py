"""The incremental forms: uploads, usage figures, conflict rescans.

Each micro-batch writes into partitions named by its number, so a batch that is run
again after a failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from docketry.operators import policies as po
from docketry.session import settle, shared_folder

#: state is kept on the executors' disks and saved to the checkpoint, not held in their heaps
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BUCKETS = 64  # parts that policies and conflicts are cut into by vehicle


def _batch_path(table: str, batch_id: int) -> str:
    return f"{table}/batch={batch_id}"


def _start(stream: DataFrame, work, name: str, checkpoint: str | None, mode: str = "append") -> StreamingQuery:
    spark = stream.sparkSession
    where = checkpoint or f"{shared_folder(spark)}/{name}"
    spark.conf.set(*STATE_STORE)
    return (
        stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", where)
        .trigger(availableNow=True).start()
    )


# --- uploads ------------------------------------------------------------------------
def stream_ingest_dedupe(
    stream: DataFrame, table: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Uploads(document_id, content_hash, arrived_at, ...) to `table`, one row per content.

    The first arrival of the batch that brings a content is taken. What has been seen is
    state by hash: a batch looks up its own hashes and never reads the table. No upload is
    too late, so the state keeps every hash; it lies in RocksDB, not in memory.
    """
    names = stream.columns
    row = F.struct(*[F.col(c) for c in names])
    # one time per batch, the same when a batch is run again
    seen = stream.withColumns({"upload": row, "batch_time": F.current_timestamp()}).groupBy("content_hash").agg(
        F.min_by("upload", F.struct("arrived_at", "document_id")).alias("row"),
        F.min("batch_time").alias("first_seen"), F.max("batch_time").alias("last_seen"))

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.filter("first_seen = last_seen").select("row.*").write.mode("overwrite").parquet(_batch_path(table, batch_id))

    return _start(seen, append, "stream_ingest_dedupe", checkpoint, "update")


# --- usage --------------------------------------------------------------------------
def usage_windows(usage: DataFrame, width: str = "1 day") -> DataFrame:
    """Calls, tokens and successes per window of created_at; batch or streaming."""
    figures = usage.groupBy(F.window("created_at", width)).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("successful"))
    return figures.select(F.col("window.start").alias("start"), "calls", "input_tokens", "output_tokens", "successful")


def stream_usage_windows(
    stream: DataFrame, table: str, delay: str = "1 hour", width: str = "1 day", checkpoint: str | None = None,
    open_too: bool = False
) -> StreamingQuery:
    """`usage_windows` over a stream, to `table`: a window is written once, when no row within
    `delay` of the newest can fall into it any more, and its state is dropped.

    With `open_too`, every batch writes the windows it adds to, with their figures so far, so that
    windows not yet ended are in the table too; readers take `current_windows`.
    Rows that come later than that are in no window; `stream_late_rows` keeps them.
    The table is partitioned by batch and by the day the window starts.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("day", F.to_date("start")).write.mode("overwrite").partitionBy("day").parquet(_batch_path(table, batch_id))

    figures = usage_windows(stream.withWatermark("created_at", delay), width)
    return _start(figures, append, "stream_usage_windows", checkpoint, "update" if open_too else "append")


def current_windows(spark: SparkSession, table: str) -> DataFrame:
    """The newest figures of each window in a table that `stream_usage_windows` fills with `open_too`."""
    shape = "start timestamp, calls long, input_tokens long, output_tokens long, successful long, batch long, day date"
    rows = spark.read.schema(shape).option("basePath", table).parquet(table)
    figures = F.struct("calls", "input_tokens", "output_tokens", "successful")
    return rows.groupBy("start").agg(F.max_by(figures, "batch").alias("f")).select("start", "f.*")


def stream_late_rows(
    stream: DataFrame, table: str, delay: str = "1 hour", width: str = "1 day", checkpoint: str | None = None
) -> StreamingQuery:
    """The rows of a stream that `stream_usage_windows` is too late to count, to `table`/late.

    The limit is that of the watermark: `delay` behind the newest row of earlier batches; a row is
    late if its window has ended by then. `table`/newest holds one row per batch.
    """
    shape = StructType.fromDDL("newest timestamp, batch long")

    def sift(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max("created_at").alias("newest")).write.mode("overwrite").parquet(_batch_path(f"{table}/newest", batch_id))
        known = spark.read.schema(shape).option("basePath", f"{table}/newest").parquet(f"{table}/newest").filter(F.col("batch") < batch_id)
        limit = known.agg((F.max("newest") - F.expr(f"interval {delay}")).alias("limit"))
        end = F.window("created_at", width)["end"]
        late = batch.withColumn("ends", end).join(F.broadcast(limit), F.col("ends") <= F.col("limit")).drop("ends", "limit")
        late.write.mode("overwrite").parquet(_batch_path(f"{table}/late", batch_id))

    return _start(stream, sift, "stream_late_rows", checkpoint)


# --- conflicts ----------------------------------------------------------------------
def _stored(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """A table in partitions bucket=.../batch=..."""
    shape = StructType([*schema.fields, StructField("bucket", IntegerType()), StructField("batch", LongType())])
    return spark.read.schema(shape).option("basePath", table).parquet(table)


def _put(rows: DataFrame, table: str, batch_id: int) -> None:
    """Write rows (with bucket) as the batch's own partitions; other partitions stay."""
    rows.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _drop_older(spark: SparkSession, table: str, kept: dict[int, int]) -> None:
    """Delete the versions of a bucket before the given one: at most as many buckets as there are."""
    for bucket, batch in kept.items():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/bucket={bucket}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(folder):
            if int(status.getPath().getName().partition("=")[2]) < batch:
                store.delete(status.getPath(), True)


def bucket_of(vehicle, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(vehicle), F.lit(buckets)).cast("int")


def conflict_schema(policies: DataFrame) -> StructType:
    """Columns of the conflicts of a table of policies."""
    return po.conflict_scan(policies.sparkSession.createDataFrame([], policies.schema))[0].drop("status").schema


def stream_conflict_rescan(
    stream: DataFrame, policies: str, conflicts: str, checkpoint: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """New policies are stored, and only the vehicles they name are scanned again.

    `policies` and `conflicts` are folders, partitioned by a hash of the vehicle and by batch. A
    batch reads the partitions its vehicles fall into and writes a whole new version of
    those of `conflicts`; versions before the one it was made from are deleted, so at most two are
    left. Readers take `current_conflicts`.
    """
    fields = stream.schema
    found_as = conflict_schema(stream)

    def rescan(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        key = po.normalize_registration(F.col("vehicle_number"))
        batch = settle(batch.withColumn("vehicle", key).withColumn("bucket", bucket_of("vehicle", buckets)))
        _put(batch.drop("vehicle"), policies, batch_id)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return
        vehicles = batch.select("vehicle").distinct()
        own = _stored(spark, policies, fields).filter(F.col("bucket").isin(touched) & (F.col("batch") <= batch_id))
        # read twice by the scan: for the vehicles of many policies, and for the pairs
        affected = settle(own.withColumn("vehicle", key).join(vehicles, "vehicle", "left_semi").select(*fields.names))
        fresh = po.conflict_scan(affected)[0].drop("status").withColumn("bucket", bucket_of("vehicle", buckets))
        # every version has a row without a vehicle, so that a bucket without conflicts has one too
        marks = batch.select("bucket").distinct()
        new = fresh.unionByName(marks, allowMissingColumns=True)
        last: dict[int, int] = {}
        if _exists(spark, conflicts):
            before = _stored(spark, conflicts, found_as).filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
            last = {r["bucket"]: r["batch"] for r in before.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}
        if last:
            newest = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
            old = before.filter((F.col("batch") == newest[F.col("bucket")]) & F.col("a_id").isNotNull()).drop("batch")
            new = new.unionByName(old.join(vehicles, "vehicle", "left_anti"))
        _put(settle(new.select(*found_as.names, "bucket")), conflicts, batch_id)
        _drop_older(spark, conflicts, last)

    return _start(stream, rescan, "stream_conflict_rescan", checkpoint)


def current_conflicts(spark: SparkSession, conflicts: str, schema: StructType) -> DataFrame:
    """Rows of the newest version of each bucket; `schema` as `conflict_schema` gives it."""
    rows = _stored(spark, conflicts, schema)
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["bucket", "batch"], "left_semi").filter("a_id is not null").drop("bucket", "batch")
