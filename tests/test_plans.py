import importlib
import subprocess
import sys
import tempfile

import pytest

from docketry.checks import load_all

FOLDER = "/root/testdata/sf0.001"
# these write or run a stream while the query is built
EAGER = ("stream_", "write_chunks", "read_text_documents", "process_vehicle", "extract_vehicle", "label_hits",
         "resolve_text", "route_questions", "escalation_context")


def test_no_query_plans_a_cross_join(spark):
    queries, _ = load_all()
    bad = []
    for key, build in queries.items():
        if key.startswith(EAGER):
            continue
        plan = build(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(key)
    assert not bad


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 160 and len(e.oracle_sql()) >= 140"
    root = importlib.import_module("docketry").__path__[0].rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {root!r}); {code}"],
                   check=True, cwd=tempfile.gettempdir())


@pytest.mark.parametrize("key", ["stream_usage_windows", "stream_ingest_dedupe", "stream_conflict_rescan"])
def test_streams_equal_batch(spark, key):
    queries, _ = load_all()
    got = sorted(map(tuple, queries[key](spark, FOLDER).collect()))
    from docketry.checks.base import Data
    from docketry.operators import policies
    from docketry.streaming import jobs
    from pyspark.sql import functions as F

    d = Data(spark, FOLDER)
    if key == "stream_conflict_rescan":
        want = policies.detect_conflicts(d.policies).select("a_id", "b_id", "conflict_type")
    elif key == "stream_ingest_dedupe":
        want = d.docs.select("content_hash").distinct()
    else:
        usage = d.usage.withColumn("created_at", F.col("created_at").cast("timestamp"))
        newest = usage.agg(F.max("created_at")).first()[0]
        closed = F.col("start") + F.expr("interval 1 day") <= F.lit(newest) - F.expr("interval 1 hour")
        want = jobs.usage_windows(usage).filter(closed).select(
            F.date_format("start", "yyyy-MM-dd"), "calls", "input_tokens", "output_tokens", "successful")
    assert got == sorted(map(tuple, want.collect()))


def test_a_late_upload_is_stored(spark, tmp_path):
    from docketry.streaming import jobs

    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    shape = "document_id long, content_hash string, arrived_at timestamp"
    for k, (hash_, day) in enumerate([("h1", 20), ("h2", 25), ("h3", 28), ("h4", 9), ("h1", 29), ("h5", 30)]):
        spark.sql(f"select {k}L as document_id, '{hash_}' as content_hash, timestamp'2024-01-{day:02d}' as arrived_at").coalesce(
            1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        jobs.stream_ingest_dedupe(stream, table, checkpoint=f"{tmp_path}/cp").awaitTermination()
    got = sorted((r.document_id, r.content_hash) for r in spark.read.parquet(table).collect())
    assert got == [(0, "h1"), (1, "h2"), (2, "h3"), (3, "h4"), (5, "h5")]


def arrive(spark, path, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(shape).parquet(path)


def test_uploads_are_known_by_state_not_by_reading_the_table(spark, tmp_path):
    """Repeated, late and restarted batches; what was written may be gone, and nothing is read twice."""
    import shutil

    from docketry.streaming import jobs
    from pyspark.sql import functions as F

    shape = "document_id long, content_hash string, arrived_at timestamp"
    source, table, written, read = f"{tmp_path}/in", f"{tmp_path}/table", [], []
    for k in range(5):
        rows = [(100 * k + i, f"h{i % 7 + 3 * k}") for i in range(20)]
        stream = arrive(spark, source, [], shape) if k == 0 else None
        spark.createDataFrame(rows, "document_id long, content_hash string").withColumn(
            "arrived_at", F.timestamp_seconds(F.lit(2_000_000_000) - F.col("document_id"))).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(shape).parquet(source)
        query = jobs.stream_ingest_dedupe(stream, table, checkpoint=f"{tmp_path}/cp")
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        written += [(r.document_id, r.content_hash) for r in spark.read.schema(shape).parquet(table).collect()]
        shutil.rmtree(table)  # the job's memory is its state
    want, known = [], set()
    for k in range(5):
        best = {}
        for i in range(20):
            h = f"h{i % 7 + 3 * k}"
            if h not in known:
                best[h] = 100 * k + i  # the largest id arrived first
        known |= set(best)
        want += [(i, h) for h, i in best.items()]
    assert sorted(written) == sorted(want)
    assert read == [20] * 5


def test_windows_close_once_and_late_rows_are_kept_apart(spark, tmp_path):
    from datetime import datetime

    from docketry.streaming import jobs

    shape = "created_at timestamp, input_tokens long, output_tokens long, success boolean"
    source, table = f"{tmp_path}/in", f"{tmp_path}/out"

    def row(day, hour, tokens):
        return (datetime(2024, 1, day, hour), tokens, 1, tokens % 2 == 0)

    batches = [[row(1, 5, 1), row(1, 9, 2)], [row(2, 1, 4)], [row(1, 23, 8), row(3, 12, 16)], [row(2, 3, 32), row(5, 0, 64)], [row(9, 0, 128)]]
    for rows in batches:
        stream = arrive(spark, source, rows, shape)
        jobs.stream_usage_windows(stream, f"{table}/windows", checkpoint=f"{tmp_path}/a").awaitTermination()
        jobs.stream_late_rows(stream, table, checkpoint=f"{tmp_path}/b").awaitTermination()
    closed = sorted((str(r.start)[:10], r.calls, r.input_tokens) for r in spark.read.parquet(f"{table}/windows").collect())
    late = sorted(r.input_tokens for r in spark.read.schema(shape).parquet(f"{table}/late").collect())
    assert closed == [("2024-01-01", 2, 3), ("2024-01-02", 1, 4), ("2024-01-03", 1, 16), ("2024-01-05", 1, 64)]
    assert late == [8, 32]


def test_rescan_touches_the_buckets_of_its_vehicles(spark, tmp_path):
    import os

    from docketry.operators import policies as po
    from docketry.streaming import jobs
    from pyspark.sql import functions as F

    rows = [(i, f"{1000000 + i % 9}", "COMPREHENSIVE", f"P{i}", f"I{i % 3}", f"2024-{1 + i % 9:02d}-01", f"2024-{3 + i % 9:02d}-20", f"f{i % 50}") for i in range(120)]
    names = ["id", "vehicle_number", "insurance_type", "policy_number", "insurer", "start_date", "end_date", "file_hash"]
    policies = spark.createDataFrame(rows, names).withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    source, stored, found = (f"{tmp_path}/{n}" for n in ("in", "stored", "found"))
    versions = []
    for part in range(4):
        # the last batch holds one vehicle only
        some = policies.filter(F.col("id") % 4 == part) if part < 3 else policies.filter("id % 4 = 3 and vehicle_number = '1000004'")
        some.coalesce(1).write.mode("append").parquet(source)
        jobs.stream_conflict_rescan(spark.readStream.schema(policies.schema).parquet(source), stored, found,
                                    checkpoint=f"{tmp_path}/cp", buckets=5).awaitTermination()
        versions.append({b: sorted(x for x in os.listdir(f"{found}/{b}") if x.startswith("batch")) for b in sorted(os.listdir(found)) if "=" in b})
    seen = policies.filter("id % 4 < 3 or vehicle_number = '1000004'")
    pair = ["a_id", "b_id", "conflict_type"]
    got = jobs.current_conflicts(spark, found, jobs.conflict_schema(policies)).select(*pair)
    want = po.conflict_scan(seen)[0].select(*pair)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    assert all(len(v) <= 2 for at in versions for v in at.values())
    changed = [b for b in versions[3] if versions[3][b] != versions[2][b]]
    assert len(changed) == 1  # and no other bucket was written


def test_windows_not_yet_ended_are_given_too(spark, tmp_path):
    from datetime import datetime

    from docketry.streaming import jobs

    shape = "created_at timestamp, input_tokens long, output_tokens long, success boolean"
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    for rows in ([(1, 5, 1), (2, 9, 2)], [(2, 20, 4), (1, 1, 8)], [(2, 23, 16), (9, 0, 32)]):
        stream = arrive(spark, source, [(datetime(2024, 1, d, h), n, 2 * n, True) for d, h, n in rows], shape)
        jobs.stream_usage_windows(stream, table, checkpoint=f"{tmp_path}/cp", open_too=True).awaitTermination()
    got = sorted((str(r.start)[:10], r.calls, r.input_tokens, r.successful) for r in jobs.current_windows(spark, table).collect())
    # the row of the first day that comes after its end is late, as before
    assert got == [("2024-01-01", 1, 1, 1), ("2024-01-02", 3, 22, 3), ("2024-01-09", 1, 32, 1)]


def test_usage_query_counts_the_newest_day(spark, tmp_path):
    from datetime import datetime

    from docketry.sources.tables import SCHEMAS

    rows = [(i, datetime(2024, 1, 1 + i // 2, 5), 1, "view", 1.0, '{"k": 3}') for i in range(5)]
    spark.createDataFrame(rows, SCHEMAS["events"]).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, load_all()[0]["stream_usage_windows"](spark, str(tmp_path)).collect()))
    assert got == [("2024-01-01", 2, 6, 12, 2), ("2024-01-02", 2, 6, 12, 2), ("2024-01-03", 1, 3, 6, 1)]
