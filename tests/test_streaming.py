import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import processes
from fleetlens.sources.buckets import BucketTable
from fleetlens.streaming import digest as sdigest
from fleetlens.streaming import runtime, state

T0 = dt.datetime(2024, 1, 1)


def batches(spark, folder, parts, schema):
    """One Parquet file per micro-batch, read back as a stream."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_live_sessions_equal_batch(spark, tmp_path):
    schema = "server string, ts timestamp, id long, time double, info string, etime double"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = []
    for s in range(0, 300, 10):
        rows.append(("s", at(s), 1, float(s % 100), f"q{s // 100}", 0.0))
        if s < 150:
            rows.append(("s", at(s), 2, float(s), "long", 0.0))
        rows.append(("s", at(s), 9, 0.0, "tick", 0.0))
    parts = [[r for r in rows if (r[1] - T0).seconds // 60 == m] for m in range(5)]
    parts.append([("s", at(3600), 99, 0.0, "end", 0.0)])
    parts.append([("s", at(7200), 99, 0.0, "end", 0.0)])
    out = state.live_sessions(batches(spark, str(tmp_path), parts, schema), "10 seconds")
    with runtime.timed_state(spark):
        runtime.append_batches(out, str(tmp_path / "out")).awaitTermination()
    live = spark.read.parquet(str(tmp_path / "out" / "data")).filter("id in (1, 2)")
    key = lambda df: sorted((r.id, r.arg, r.first_seen, r.Query_time, r.samples) for r in df.collect())
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert key(live) == key(processes.sessions(whole).filter("id in (1, 2)"))


def test_late_rows_are_counted(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    parts = [[("a", T0 + dt.timedelta(hours=h), 1.0)] for h in (0, 10, 20)] + [[("a", T0, 5.0)]]
    stream = batches(spark, str(tmp_path), parts, schema)
    late = runtime.LateRows()
    spark.streams.addListener(late)
    try:
        q = runtime.append_batches(sdigest.windowed_buckets(stream, ["k"], "v", "ts", "1 hour", "1 hour"), str(tmp_path / "o"), "update")
        q.awaitTermination()
        for _ in range(100):  # events come after the batch
            if late.rows(q):
                break
            time.sleep(0.1)
        assert late.rows(q) == 1
    finally:
        spark.streams.removeListener(late)


def test_first_rows_of_a_stream(spark, tmp_path):
    schema = "c string, pos long"
    parts = [[("a", 2), ("a", 1), ("b", 1), (None, 9)], [("a", 4), ("a", 3), ("b", 2), ("b", 4), ("b", 3)] + [("a", 100 + i) for i in range(500)], [("a", 0), (None, 1), (None, 2), (None, 3)]]
    with runtime.timed_state(spark):
        out = state.stream_first(batches(spark, str(tmp_path), parts, schema), "c", 3, ["pos"], held=2)
        runtime.append_batches(out, str(tmp_path / "o")).awaitTermination()
    got = sorted(((r.c or "", r.pos) for r in spark.read.parquet(str(tmp_path / "o" / "data")).collect()))
    assert got == [("", 1), ("", 2), ("", 9), ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]


def test_alerts_are_kept_once(spark, tmp_path):
    watches = spark.createDataFrame([("load", ">", 5.0)], "name string, cmp string, threshold double")
    alert = state.alert_batches(watches, ["server"], str(tmp_path / "a"))
    values = spark.createDataFrame([("s1", "load", 9.0), ("s2", "load", 1.0)], "server string, name string, value double")
    for batch_id in (0, 1, 1):
        alert(values, batch_id)
    assert sorted((r.server, r.batch_id) for r in state.alerts(spark, str(tmp_path / "a")).collect()) == [("s1", 0), ("s1", 1)]


def test_late_rows_are_kept(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    seen = []
    run = state.late_batches(str(tmp_path), "ts", "1 hour", "2 hours", lambda df, i: seen.extend((i, r.v) for r in df.collect()))
    parts = [[(1, at(0)), (2, at(9))], [(3, at(5)), (4, at(7)), (5, None)], [(6, at(1))]]
    for i, rows in enumerate(parts):
        for _ in range(2):
            run(spark.createDataFrame(rows, "v int, ts timestamp"), i)
    assert sorted((r.v, r.batch_id) for r in state.late_rows(spark, str(tmp_path)).collect()) == [(3, 1), (6, 2)]
    assert sorted(set(seen)) == [(0, 1), (0, 2), (1, 4), (1, 5)]


def test_review_merge_is_idempotent(spark, tmp_path):
    cols = "checksum long, fingerprint string, sample string, first_seen timestamp, last_seen timestamp"
    table = BucketTable(spark, str(tmp_path / "r"), ["checksum"], 8)
    table.replace(spark.createDataFrame([], cols + ", reviewed_by string, reviewed_on timestamp, comments string"))
    events = spark.createDataFrame([(1, T0), (1, T0 + dt.timedelta(hours=1)), (2, T0)], "k long, ts timestamp")

    def summarize(b):
        return b.groupBy(F.col("k").alias("checksum")).agg(
            F.lit("f").alias("fingerprint"), F.lit("s").alias("sample"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    run = state.merge_batches(table, "2024-02-01", summarize)
    run(events, 0)
    once = sorted(map(tuple, table.read().collect()))
    run(events, 0)
    assert sorted(map(tuple, table.read().collect())) == once and len(once) == 2 and table.manifest()[0]["number"] == 1
    run(events, 1)
    assert sorted(map(tuple, table.read().collect())) == once and table.manifest()[0]["number"] == 2


def test_shared_dir_reads_the_cluster_setting():
    class Conf:
        def get(self, name, default=None):
            return "/shared/place" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert runtime.shared_dir(Session(), "x").startswith("/shared/place/x-")


@pytest.fixture(autouse=True)
def stop_streams(spark):
    yield
    for q in spark.streams.active:
        q.stop()
