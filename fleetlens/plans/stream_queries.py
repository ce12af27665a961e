"""Streams over ``events`` run to the end of the given files; their oracles are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import numbers
from fleetlens.operators import lineage
from fleetlens.plans import derived
from fleetlens.plans.derived import STATUS_SQL
from fleetlens.plans.digest_queries import stats_sql
from fleetlens.plans.filter_queries import SESSIONS_SQL, session_columns, session_samples
from fleetlens.plans.lifecycle_queries import HOSTS_SQL, host_observations
from fleetlens.plans.registry import Tables, query, rounded, when_ts
from fleetlens.sources.buckets import BucketTable
from fleetlens.streaming import digest as sdigest
from fleetlens.streaming import runtime, state


def _event_stream(t: Tables):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet")


@query("stream_window_report", f"""
WITH e AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') || event_type AS k, value AS v FROM events), {stats_sql('e', 'k')}
SELECT k, cnt, round(s, 4) AS sum, lo AS min, hi AS max, round(pct_95, 6) AS pct_95, round(median, 6) AS median, round(stddev, 5) AS stddev, round(s / cnt, 6) AS avg FROM stats""")
def stream_window_report(t: Tables):
    folder = runtime.shared_dir(t.spark, "window-report")
    buckets = sdigest.windowed_buckets(_event_stream(t), ["event_type"], "value", "ts", "1 day", "2 days")
    runtime.append_batches(buckets, folder, "update").awaitTermination()
    rows = runtime.latest_rows(t.spark, folder, ["start", "event_type", "bucket"])
    out = sdigest.window_report(rows, ["event_type"])
    out = out.select(F.concat(F.date_format("start", "yyyy-MM-dd"), "event_type").alias("k"), "cnt", "sum", "min", "max", "pct_95", "median", "stddev", "avg")
    return rounded(rounded(rounded(out, 4, "sum"), 6, "pct_95", "median", "avg"), 5, "stddev")


@query("stream_rollup", """
SELECT date_trunc('hour', ts) AS bucket, event_type, round(avg(value), 9) AS average, max(value) AS max, min(value) AS min, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_rollup(t: Tables):
    folder = runtime.shared_dir(t.spark, "rollup")
    roll = sdigest.rollup_stream(_event_stream(t), ["event_type"], "ts", "value", "1 hour", "2 days")
    runtime.append_batches(roll, folder, "update").awaitTermination()
    out = runtime.latest_rows(t.spark, folder, ["bucket", "event_type"])
    return rounded(out.withColumn("bucket", when_ts("bucket")), 9, "average")


@query("stream_samples", """
SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 5""")
def stream_samples(t: Tables):
    """The first five events of each type from files of four times, read one after the other."""
    folder = runtime.shared_dir(t.spark, "samples")
    stream = _in_parts(t, folder, t.events.select("event_type", "event_id"), F.floor(F.col("event_id") * 4 / (t.events.agg(F.max("event_id")).scalar() + 1)))
    with runtime.timed_state(t.spark):
        runtime.append_batches(state.stream_first(stream, "event_type", 5, ["event_id"]), folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/data").select("event_type", "event_id")


def _in_parts(t: Tables, folder: str, rows, part, n: int = 4):
    """A stream of ``n`` folders of files that hold the rows with ``part`` 0, 1, ..., one micro-batch each."""
    stored = lineage.written(rows.withColumn("_part", part.cast("int")), "parts")
    for i in range(n):
        stored.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{folder}/in/part{i}")
    source = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return source.parquet(f"{folder}/in")


@query("stream_review", """
WITH s AS (SELECT user_id AS k, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1)
SELECT k AS checksum, CASE WHEN k % 2 = 0 THEN 'known' ELSE 'f' || k END AS fingerprint, CASE WHEN k % 2 = 0 THEN least(TIMESTAMP '2024-01-05', lo) ELSE lo END AS first_seen,
  CASE WHEN k % 2 = 0 THEN greatest(TIMESTAMP '2024-01-05', hi) ELSE hi END AS last_seen, CASE WHEN k % 10 = 0 THEN 'ann' END AS reviewed_by FROM s""")
def stream_review(t: Tables):
    """A review table that knows half the users, widened by every batch of the stream."""
    folder = runtime.shared_dir(t.spark, "review")
    mid = F.lit("2024-01-05").cast("timestamp")
    known = t.events.filter("user_id % 2 = 0").select(F.col("user_id").alias("checksum")).distinct()
    table = BucketTable(t.spark, f"{folder}/table", ["checksum"], 16)
    table.replace(known.select(
        "checksum", F.lit("known").alias("fingerprint"), F.lit("s").alias("sample"), mid.alias("first_seen"), mid.alias("last_seen"),
        F.when(F.col("checksum") % 10 == 0, "ann").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_on"), F.lit(None).cast("string").alias("comments"),
    ))

    def seen(batch):
        at = F.col("ts").cast("timestamp")
        return batch.groupBy(F.col("user_id").alias("checksum")).agg(F.concat(F.lit("f"), F.first("user_id")).alias("fingerprint"), F.lit("s2").alias("sample"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))

    _each_batch(_in_parts(t, folder, t.events.select("user_id", "ts"), F.col("user_id") % 4), folder, state.merge_batches(table, "2024-03-01", seen))
    out = table.read().select("checksum", "fingerprint", "first_seen", "last_seen", "reviewed_by")
    return out.withColumns({c: when_ts(c) for c in ("first_seen", "last_seen")})


def _each_batch(stream, folder: str, run) -> None:
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@query("stream_hosts", f"""
WITH {HOSTS_SQL} SELECT checksum, host, 167772160 + CASE WHEN type = 'SOURCE' THEN CAST(substr(host, 8) AS BIGINT) ELSE 256 + CAST(substr(host, 8) AS BIGINT) END AS ip, type,
  min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY 1, 2, 3, 4""")
def stream_hosts(t: Tables):
    """The host map of a stream, upserted batch by batch."""
    folder = runtime.shared_dir(t.spark, "hosts")
    observe = lambda batch: host_observations(batch).withColumn("ip", numbers.ip_to_long("host"))
    table = BucketTable(t.spark, f"{folder}/table", ["checksum", "host", "ip", "type"], 16)
    table.replace(observe(t.events).limit(0))
    _each_batch(_in_parts(t, folder, t.events, F.col("event_id") % 4), folder, state.merge_host_batches(table, observe))
    return table.read().select("checksum", "host", "ip", "type", "first_seen", "last_seen")


@query("stream_sessions", SESSIONS_SQL)
def stream_sessions(t: Tables):
    """Samples of a month in four parts, followed live: what is finished equals the batch form."""
    folder = runtime.shared_dir(t.spark, "sessions")
    samples = session_samples(t)
    day = F.to_date("ts")
    first, last = samples.agg(F.min(day)).scalar(), samples.agg(F.max(day)).scalar()
    stream = _in_parts(t, folder, samples, F.floor(F.date_diff(day, first) * 4 / (F.date_diff(last, first) + 1)))
    with runtime.timed_state(t.spark):
        runtime.append_batches(state.live_sessions(stream, "0 seconds"), folder).awaitTermination()
    return session_columns(t.spark.read.parquet(f"{folder}/data"))


@query("stream_watch", f"""
WITH m AS (SELECT server, date_trunc('hour', ts) AS hour, event_id % 4 AS part, name, max(value) AS value FROM {STATUS_SQL} GROUP BY 1, 2, 3, 4)
SELECT server, strftime(hour, '%Y-%m-%d %H') AS hour, part AS batch_id, CAST(sum(CASE WHEN (name = 'error' AND value > 40) OR (name = 'view' AND value > 50) THEN 1 ELSE 0 END) AS BIGINT) AS n_failed
FROM m WHERE name IN ('error', 'view') GROUP BY 1, 2, 3 HAVING n_failed > 0""")
def stream_watch(t: Tables):
    """Alerts of each batch of a metric stream, kept once per batch."""
    folder = runtime.shared_dir(t.spark, "watch")
    watches = t.spark.createDataFrame([("error", ">", 40.0), ("view", ">", 50.0)], "name string, cmp string, threshold double")
    alert = state.alert_batches(watches, ["server", "hour"], f"{folder}/alerts")

    def run(batch, batch_id):
        metrics = batch.groupBy("server", F.date_trunc("hour", "ts").alias("hour"), "name").agg(F.max("value").alias("value"))
        alert(metrics, batch_id)
        alert(metrics, batch_id)  # a batch that comes again changes nothing

    _each_batch(_in_parts(t, folder, derived.status_values(t), F.col("event_id") % 4), folder, run)
    return state.alerts(t.spark, f"{folder}/alerts").select("server", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.col("batch_id").cast("long").alias("batch_id"), "n_failed")


LATE_SQL = """
WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN 3 ELSE floor(event_id * 4 / (SELECT max(event_id) + 1 FROM events)) END AS b FROM events),
m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR AS mark FROM e GROUP BY b)
"""


@query("stream_late", LATE_SQL + """SELECT CASE WHEN date_trunc('day', e.ts) + INTERVAL 1 DAY <= m.mark THEN 'late' ELSE 'in time' END AS kind, e.event_id, CAST(e.b AS BIGINT) AS batch_id
FROM e JOIN m ON m.b = e.b""")
def stream_late(t: Tables):
    """A seventh of the events comes with the last batch; those whose day is closed by then are kept aside."""
    folder = runtime.shared_dir(t.spark, "late")
    spread = F.floor(F.col("event_id") * 4 / (t.events.agg(F.max("event_id")).scalar() + 1))
    stream = _in_parts(t, folder, t.events.select("event_id", "ts"), F.when(F.col("event_id") % 7 == 0, 3).otherwise(spread))
    keep = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/in_time/batch_id={batch_id}")
    _each_batch(stream, folder, state.late_batches(folder, "ts", "1 day", "12 hours", keep))
    late = state.late_rows(t.spark, folder).withColumn("kind", F.lit("late"))
    timely = t.spark.read.option("basePath", f"{folder}/in_time").parquet(f"{folder}/in_time/batch_id=*").withColumn("kind", F.lit("in time"))
    return late.unionByName(timely).select("kind", "event_id", F.col("batch_id").cast("long").alias("batch_id"))
