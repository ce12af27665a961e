"""Checks and thresholds over derived metrics, processes, checksums and backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import checks, consistency, ordered, reports
from fleetlens.operators import topology as topo
from fleetlens.plans import derived
from fleetlens.plans.derived import PROC_SQL, STATUS_SQL
from fleetlens.plans.registry import Tables, query, rounded

WATCH_SQL = f"""
WITH m AS (SELECT server, date_trunc('day', ts) AS day, name, max(value) AS value FROM {STATUS_SQL} GROUP BY 1, 2, 3),
h AS (SELECT server, day, sum(CASE WHEN (name = 'error' AND value > 40) OR (name = 'view' AND value > 50) THEN 1 ELSE 0 END) AS n FROM m WHERE name IN ('error', 'view') GROUP BY 1, 2)"""


def _watched(t: Tables, require_all: bool):
    day = F.date_trunc("day", "ts")
    m = derived.status_values(t).groupBy("server", day.alias("day"), "name").agg(F.max("value").alias("value"))
    # Watches are rows; they come from the given metrics so that the table names are theirs.
    w = t.events.groupBy(F.col("event_type").alias("name")).agg(F.lit(">").alias("cmp")).filter("name in ('error', 'view')").withColumn(
        "threshold", F.when(F.col("name") == "error", 40.0).otherwise(50.0)
    )
    return checks.watch(m, w, ["server", "day"], require_all).select("server", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_failed", "failed")


@query("watch_any", WATCH_SQL + " SELECT server, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n_failed, n > 0 AS failed FROM h")
def watch_any(t: Tables):
    return _watched(t, False)


@query("watch_all", WATCH_SQL + " SELECT server, strftime(day, '%Y-%m-%d') AS day, CAST(n AS BIGINT) AS n_failed, n = 2 AS failed FROM h")
def watch_all(t: Tables):
    return _watched(t, True)


WIDE_SQL = f"""
WITH m AS (SELECT server, hour(ts) AS run, max(CASE WHEN name = 'error' THEN value END) AS error, max(CASE WHEN name = 'view' THEN value END) AS view
  FROM {STATUS_SQL} WHERE name IN ('error', 'view') GROUP BY 1, 2)"""


def _wide(t: Tables):
    s = derived.status_values(t).withColumn("run", F.hour("ts"))
    return checks.wide_metrics(s, ["server", "run"], ["error", "view"])


@query("expression_check", WIDE_SQL + """, r AS (SELECT *, round(error / view * 100, 2) AS result FROM m)
SELECT server, run, result, CASE WHEN result IS NULL THEN 'UNKNOWN' WHEN result > 150 THEN 'CRITICAL' WHEN result > 100 THEN 'WARNING' ELSE 'OK' END AS status FROM r""")
def expression_check(t: Tables):
    return checks.expression_check(_wide(t), "error / view * 100", ">", 100, 150).select("server", "run", "result", "status")


@query("delta_check", WIDE_SQL + """, r AS (SELECT a.server, a.run, round(a.error - b.error, 2) AS result FROM m a LEFT JOIN m b ON a.server = b.server AND b.run = a.run - 1)
SELECT server, run, result, CASE WHEN result IS NULL THEN 'UNKNOWN' WHEN result > 40 THEN 'CRITICAL' WHEN result > 10 THEN 'WARNING' ELSE 'OK' END AS status FROM r""")
def delta_check(t: Tables):
    w = _wide(t)
    last = w.withColumn("run", F.col("run") + 1)
    return checks.delta_check(w, last, ["server", "run"], "error - last_error", ">", 10, 40).select("server", "run", "result", "status")


@query("long_queries", f"""
WITH p AS (SELECT server, CASE WHEN user NOT LIKE '%system user%' AND command NOT IN ('Sleep', 'Binlog Dump') AND info IS NOT NULL AND time <> 0 THEN time END AS t FROM {PROC_SQL})
SELECT server, max(t) AS max_time, count(*) FILTER (t > 100) AS over_warning, count(*) FILTER (t > 300) AS over_critical,
  CASE WHEN count(*) FILTER (t > 300) > 0 THEN 'CRITICAL' WHEN count(*) FILTER (t > 100) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM p GROUP BY 1""")
def long_queries(t: Tables):
    return checks.long_queries(derived.processes(t), ["server"], 100, 300)


@query("locked_queries", f"""
WITH p AS (SELECT server, CASE WHEN state = 'Locked' AND command = 'Query' THEN time END AS t FROM {PROC_SQL})
SELECT server, count(*) FILTER (t >= 60) AS critical_queries, count(*) FILTER (t >= 20 AND t < 60) AS warning_queries, coalesce(max(t), 0) AS max_time,
  CASE WHEN count(*) FILTER (t >= 60) > 0 THEN 'CRITICAL' WHEN count(*) FILTER (t >= 20 AND t < 60) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM p GROUP BY 1""")
def locked_queries(t: Tables):
    return checks.locked_queries(derived.processes(t), ["server"], 20, 60)


@query("connections", f"""
SELECT server, count(*) AS total, count(*) FILTER (command = 'Query') AS query, count(*) FILTER (command = 'Sleep') AS sleep, count(*) FILTER (command = 'Connect') AS "connect",
  count(*) FILTER (command = 'Binlog Dump') AS binlog_dump, 0 AS other, CASE WHEN count(*) >= 2500 THEN 'CRITICAL' WHEN count(*) >= 2000 THEN 'WARNING' ELSE 'OK' END AS status FROM {PROC_SQL} GROUP BY 1""")
def connections(t: Tables):
    return checks.connections(derived.processes(t), ["server"], 2000, 2500)


@query("slow_queries", f"""
SELECT server, count(*) FILTER (command = 'Query' AND time >= 30) AS slow, CASE WHEN count(*) FILTER (command = 'Query' AND time >= 30) >= 300 THEN 'CRITICAL'
  WHEN count(*) FILTER (command = 'Query' AND time >= 30) >= 100 THEN 'WARNING' ELSE 'OK' END AS status FROM {PROC_SQL} GROUP BY 1""")
def slow_queries(t: Tables):
    return checks.slow_queries(derived.processes(t), ["server"], 30, 100, 300)


@query("range_check_any", """
SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (o_totalprice >= 490000) AS critical, count(*) FILTER (o_totalprice BETWEEN 400000 AND 480000) AS warning,
  CASE WHEN count(*) FILTER (o_totalprice >= 490000) > 0 THEN 'CRITICAL' WHEN count(*) FILTER (o_totalprice BETWEEN 400000 AND 480000) > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM orders GROUP BY 1""")
def range_check_any(t: Tables):
    return checks.range_check(t.orders, ["o_orderpriority"], "o_totalprice", "400000:480000", "490000")


@query("range_check_words", """
SELECT o_custkey, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS critical, count(*) FILTER (o_orderstatus = 'P') AS warning,
  CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'P')) < count(*) THEN 'OK' WHEN count(*) FILTER (o_orderstatus = 'F') >= count(*) FILTER (o_orderstatus = 'P') THEN 'CRITICAL' ELSE 'WARNING' END AS status FROM orders GROUP BY 1""")
def range_check_words(t: Tables):
    return checks.range_check(t.orders, ["o_custkey"], "o_orderstatus", "P", "F", "all")


@query("lag_band", """
SELECT event_id, CASE WHEN value < 0.1 THEN 'CRITICAL' WHEN value < 1 THEN 'WARNING' WHEN value > 100 THEN 'CRITICAL' WHEN value > 50 THEN 'WARNING' ELSE 'OK' END AS status FROM events""")
def lag_band(t: Tables):
    return checks.lag_band(t.events, "value", 1, 50, 0.1, 100).select("event_id", "status")


@query("heartbeat_lag", """
SELECT event_type, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-01-30')) - floor(epoch(max(ts))) AS BIGINT)) AS lag FROM events GROUP BY 1""")
def heartbeat_lag(t: Tables):
    beats = t.events.groupBy("event_type").agg(F.max("ts").alias("beat"))
    return checks.heartbeat_lag(beats, "beat", "2024-01-30").select("event_type", "lag")


# Replica copy of lineitem: some rows lost, some changed.
LOST, CHANGED = "l_orderkey % 1999 = 3", "l_partkey % 997 = 5"


def _replica(t: Tables):
    li = t.lineitem.filter(f"NOT ({LOST})")
    return li.withColumn("l_quantity", F.when(F.expr(CHANGED), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))


def _chunks(df, size=500):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return consistency.chunk_checksums(df, "l_orderkey", cols, size, low=0).withColumns({"db": F.lit("d"), "tbl": F.lit("lineitem")})


CHUNK_SQL = f"""
WITH m AS (SELECT l_orderkey // 500 AS chunk, count(*) AS cnt, min(l_orderkey) AS lo, max(l_orderkey) AS hi, bool_or({LOST}) AS lost,
  bool_or(({CHANGED}) AND NOT ({LOST})) AS changed, count(*) FILTER (NOT ({LOST})) AS kept FROM lineitem GROUP BY 1)"""


@query("chunk_counts", CHUNK_SQL + " SELECT chunk, lo AS lower_boundary, hi AS upper_boundary, cnt FROM m")
def chunk_counts(t: Tables):
    return _chunks(t.lineitem).select("chunk", "lower_boundary", "upper_boundary", "cnt")


@query("checksum_differences", CHUNK_SQL + """
SELECT 'lineitem' AS tbl, chunk, kept AS this_cnt, cnt AS master_cnt, kept - cnt AS cnt_diff, 1 AS crc_diff FROM m WHERE lost OR changed""")
def checksum_differences(t: Tables):
    both = consistency.compare_checksums(_chunks(_replica(t)), _chunks(t.lineitem))
    return consistency.checksum_differences(both).select("tbl", "chunk", "this_cnt", "master_cnt", "cnt_diff", "crc_diff")


@query("recent_checksums", CHUNK_SQL + """
SELECT chunk % 10 AS host, count(*) FILTER (chunk % 3 > 0) AS recent, count(*) FILTER (chunk % 3 > 0 AND (lost OR changed)) AS different,
  CASE WHEN count(*) FILTER (chunk % 3 > 0) = 0 OR count(*) FILTER (chunk % 3 > 0 AND (lost OR changed)) > 0 THEN 'CRITICAL' ELSE 'OK' END AS status FROM m GROUP BY 1""")
def recent_checksums(t: Tables):
    both = consistency.compare_checksums(_chunks(_replica(t)), _chunks(t.lineitem)).withColumns({
        "host": F.col("chunk") % 10, "ts": F.when(F.col("chunk") % 3 > 0, F.lit("2024-01-02")).otherwise(F.lit("2023-01-01")).cast("timestamp"),
    })
    since = F.lit("2024-01-01").cast("timestamp")
    return checks.recent_checksums(both, consistency.checksum_differences(both), ["host"], since)


@query("table_checksums", """
SELECT 'orders' AS table_name, 'same' AS state, count(*) AS exported_cnt, count(*) AS imported_cnt FROM orders
UNION ALL SELECT 'lineitem', 'different', (SELECT count(*) FROM lineitem), count(*) FROM lineitem WHERE NOT (l_orderkey % 1999 = 3)
UNION ALL SELECT 'part', 'missing', count(*), NULL FROM part""")
def table_checksums(t: Tables):
    def one(df, name):
        return consistency.table_checksum(df, name, sorted(df.columns))

    exported = one(t.orders, "orders").unionByName(one(t.lineitem, "lineitem")).unionByName(one(t.part, "part"))
    imported = one(t.orders.repartition(3), "orders").unionByName(one(_replica(t), "lineitem"))
    return consistency.compare_table_lists(exported, imported)


@query("walk_batches", """
SELECT (o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 50 AS batch, count(*) AS n FROM orders GROUP BY 1""")
def walk_batches(t: Tables):
    return consistency.batches(t.orders, "o_orderkey", 50).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("walk_order", """
WITH i AS (SELECT p_brand AS table_name, 'k' || p_partkey AS key_name, CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'unique' ELSE 'key' END AS kt,
  CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'timestamp' ELSE 'varchar' END AS ct FROM part),
r AS (SELECT table_name, key_name, CASE kt WHEN 'primary' THEN 0 WHEN 'unique' THEN 2 ELSE 4 END + CASE ct WHEN 'int' THEN 1 ELSE 2 END AS preference FROM i WHERE ct <> 'varchar')
SELECT table_name, key_name, preference, row_number() OVER (PARTITION BY table_name ORDER BY preference, key_name) AS position FROM r""")
def walk_order(t: Tables):
    i = t.part.select(
        F.col("p_brand").alias("table_name"), F.concat(F.lit("k"), "p_partkey").alias("key_name"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'unique' ELSE 'key' END").alias("key_type"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'timestamp' ELSE 'varchar' END").alias("column_type"),
    )
    return consistency.walk_order(i).select("table_name", "key_name", "preference", "position")


@query("future_partitions", """
SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_bound, CASE WHEN max(o_orderdate) < TIMESTAMP '1998-10-01' THEN 'CRITICAL' ELSE 'OK' END AS status FROM orders GROUP BY 1""")
def future_partitions(t: Tables):
    p = t.orders.select("o_custkey", F.col("o_orderdate").alias("bound"))
    p = p.unionByName(p.select("o_custkey").distinct().withColumn("bound", F.lit(None).cast("timestamp_ntz")))
    out = checks.future_partitions(p, ["o_custkey"], F.lit("1998-10-01").cast("timestamp_ntz"))
    return out.withColumn("last_bound", F.date_format("last_bound", "yyyy-MM-dd"))


@query("backup_freshness", """
WITH b AS (SELECT 'set' || o_custkey AS s, CAST(o_orderkey % 2 AS INTEGER) AS l, o_orderdate AS d, CASE WHEN o_orderstatus = 'F' THEN 'Backup failed' ELSE 'Backup succeeded' END AS st, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
x AS (SELECT s, l, arg_max(st, (d, st)) AS st FROM b GROUP BY 1, 2), e AS (SELECT 'set' || c_custkey AS s, unnest([0, 1]) AS l FROM customer)
SELECT e.s AS backup_set, e.l AS backup_level, st AS backup_status, CASE WHEN st LIKE '%succe%' THEN 'OK' ELSE 'CRITICAL' END AS status FROM e LEFT JOIN x ON e.s = x.s AND e.l = x.l""")
def backup_freshness(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "Backup failed").otherwise("Backup succeeded")
    b = t.orders.select(
        F.concat(F.lit("set"), "o_custkey").alias("backup_set"), (F.col("o_orderkey") % 2).cast("int").alias("backup_level"),
        F.col("o_orderdate").alias("backup_date"), status.alias("backup_status"),
    )
    # One row per date, so that the latest is well defined.
    b = b.groupBy("backup_set", "backup_level", "backup_date").agg(F.max("backup_status").alias("backup_status"))
    expected = t.customer.select(F.concat(F.lit("set"), "c_custkey").alias("backup_set"), F.explode(F.array(F.lit(0), F.lit(1))).alias("backup_level"))
    out = checks.backup_freshness(expected, b, F.lit("1998-01-01").cast("timestamp_ntz"))
    return out.select("backup_set", "backup_level", "backup_status", "status")


@query("role_consistency", """
SELECT s_suppkey, CASE WHEN (s_suppkey % 3 = 0) = (s_nationkey % 2 = 0) THEN 'CRITICAL' ELSE 'OK' END AS status FROM supplier""")
def role_consistency(t: Tables):
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("read_only"), (F.col("s_nationkey") % 2 == 0).alias("is_master"))
    return checks.role_check(s).select("s_suppkey", "status")


@query("job_outcomes", """
WITH m AS (SELECT user_id, event_id, event_type = 'click' AS s FROM events WHERE event_type IN ('click', 'error')),
n AS (SELECT *, lead(s) OVER w AS ns, lead(event_id) OVER w AS ne FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id AS started, CASE WHEN NOT coalesce(ns, true) THEN ne END AS ended, NOT coalesce(ns, true) AS success FROM n WHERE s""")
def job_outcomes(t: Tables):
    return checks.job_outcomes(
        t.events, ["user_id"], "event_id", F.col("event_type") == "click", F.col("event_type") == "error", ordered.id_block("event_id")
    )


# --- references between servers and clusters ---------------------------------------------


@query("referential_violations", """
WITH s AS (SELECT 's' || s_suppkey AS server, s_suppkey AS k, 'c' || s_suppkey // 4 AS cluster, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE '8.0' END AS version FROM supplier),
cl AS (SELECT DISTINCT 'c' || s_suppkey // 4 AS cluster, s_suppkey // 4 AS g FROM supplier WHERE s_suppkey // 4 % 10 <> 7),
wf AS (SELECT server, cluster FROM s WHERE k % 2 = 0), rf AS (SELECT server, cluster FROM s WHERE k % 2 = 1)
SELECT 'MissingKey:version' AS rule, server, NULL AS cluster FROM s WHERE version IS NULL
UNION ALL SELECT 'UnknownCluster', server, cluster FROM s WHERE cluster NOT IN (SELECT cluster FROM cl)
UNION ALL SELECT 'ClusterMismatch', server, cluster FROM s WHERE cluster IN (SELECT cluster FROM cl) AND k % 5 = 0
UNION ALL SELECT 'PrimaryMismatch', 's' || (g * 4 + g % 3), cluster FROM cl WHERE ('s' || (g * 4 + g % 3), cluster) NOT IN (SELECT server, cluster FROM wf)
UNION ALL SELECT 'FailoverMismatch', 's' || (g * 4 + 3 - g % 2), cluster FROM cl WHERE ('s' || (g * 4 + 3 - g % 2), cluster) NOT IN (SELECT server, cluster FROM rf)""")
def referential_violations(t: Tables):
    # Four servers share a cluster, so member lists stay short.
    key = F.col("s_suppkey")
    g = F.floor(key / 4)
    mine = F.array(F.concat(F.lit("c"), g.cast("string")))
    none = F.array().cast("array<string>")
    servers = t.supplier.select(
        F.concat(F.lit("s"), key).alias("server"), F.lit("true").alias("active"), F.when(key % 9 > 0, "8.0").alias("version"),
        F.when(key % 2 == 1, mine).otherwise(none).alias("readfor"), F.when(key % 2 == 0, mine).otherwise(none).alias("writefor"),
    )
    member = F.when(key % 5 > 0, F.concat(F.lit("s"), key))
    clusters = t.supplier.groupBy(g.alias("g")).agg(F.collect_list(member).alias("servers")).filter("g % 10 <> 7").select(
        F.concat(F.lit("c"), "g").alias("cluster"), F.lit("true").alias("active"), F.array(F.lit("d")).alias("schemas"),
        F.concat(F.lit("s"), F.col("g") * 4 + F.col("g") % 3).alias("primary"),
        F.concat(F.lit("s"), F.col("g") * 4 + 3 - F.col("g") % 2).alias("failover"), "servers",
    )
    return topo.referential_violations(servers, clusters)


@query("orphaned_orders", """
SELECT 'UnknownCustomer' AS rule, o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)""")
def orphaned_orders(t: Tables):
    parents = t.customer.filter("c_nationkey <> 3")
    return topo.missing_references(t.orders, parents, "o_custkey", "c_custkey", "UnknownCustomer").select("rule", "o_orderkey", "o_custkey")


@query("cluster_hosts", """
SELECT 'c' || s_nationkey AS cluster, s_name AS server FROM supplier WHERE s_suppkey % 4 > 0""")
def cluster_hosts(t: Tables):
    s = t.supplier.select(
        F.col("s_name").alias("server"), F.when(F.col("s_suppkey") % 4 > 0, "true").otherwise("false").alias("active"),
        F.array(F.concat(F.lit("c"), "s_nationkey")).alias("readfor"),
    )
    return topo.hosts_for(s, "readfor")


@query("backup_chains", """
WITH RECURSIVE b AS (SELECT o_custkey AS g, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r,
   lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
l AS (SELECT g, k, CASE WHEN (r - 1) % 6 = 0 AND g % 5 > 0 THEN 0 ELSE 1 END AS level, prev FROM b),
c AS (SELECT g, k, k AS at, level, prev, 0 AS steps FROM l UNION ALL SELECT c.g, c.k, l.k, l.level, l.prev, c.steps + 1 FROM c JOIN l ON c.level > 0 AND l.g = c.g AND l.k = c.prev)
SELECT l.g AS grp, l.k AS backup, f.at AS full_backup, f.steps, f.at IS NOT NULL AS complete FROM l LEFT JOIN (SELECT * FROM c WHERE level = 0) f ON f.g = l.g AND f.k = l.k""")
def backup_chains(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("backup_directory"))
    o = ordered.running_sum(o, {"r": F.lit(1)}, ["backup_directory"], ordered.id_block("backup_directory"), ["grp"])
    o = ordered.previous(o, ["backup_directory"], ["backup_directory"], ordered.id_block("backup_directory"), ["grp"])
    level = F.when(((F.col("r") - 1) % 6 == 0) & (F.col("grp") % 5 > 0), 0).otherwise(1)
    o = o.select("grp", "backup_directory", F.col("prev_backup_directory").alias("last_backup"), level.alias("backup_level"))
    return topo.backup_chain(o, group=["grp"])


@query("latency_index", f"""
WITH q AS (SELECT server, (arg_max(event_id, (ts, event_id)) - arg_min(event_id, (ts, event_id))) / (epoch(max(ts)) - epoch(min(ts))) AS qps FROM {STATUS_SQL} GROUP BY 1),
r AS (SELECT server, avg(value - 1) AS mean_running FROM {STATUS_SQL} GROUP BY 1)
SELECT q.server, round(qps, 9) AS qps, round(mean_running, 6) AS mean_running, round(mean_running / qps, 2) AS latency_index FROM q JOIN r ON q.server = r.server""")
def latency_index(t: Tables):
    s = derived.status_values(t)
    status = s.select("server", "ts", F.col("event_id").alias("questions"))
    samples = s.select("server", "ts", F.col("value").alias("running"))
    out = reports.latency_index(status, samples, ["server"])
    return rounded(rounded(rounded(out, 9, "qps"), 6, "mean_running"), 2, "latency_index")
