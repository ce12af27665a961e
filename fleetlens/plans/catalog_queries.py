"""Versions, snapshots, privileges, sizes, growth and roll-ups over derived catalogue rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import privileges as pv
from fleetlens.operators import catalog as cat
from fleetlens.operators import ordered
from fleetlens.plans import derived
from fleetlens.plans.derived import VERSION_SQL
from fleetlens.plans.registry import Tables, query, rounded, when_ts

SINCE = "TIMESTAMP '1997-01-01'"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# Snapshot links: txn t holds the versions whose key divides by t, for three runs.
LINKS_SQL = """(SELECT 1 AS collector_run_id, o_orderkey AS statistic_id, x.t AS txn, NULL AS parent_txn, o_orderdate AS run_time
  FROM orders, (SELECT unnest([1, 2, 3]) AS t) x WHERE o_orderkey % x.t = 0)"""


def _links(t: Tables):
    txn = F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda x: F.col("o_orderkey") % x == 0))
    return t.orders.select(
        F.lit(1).alias("collector_run_id"), F.col("o_orderkey").alias("statistic_id"), txn.alias("txn"),
        F.lit(None).cast("long").alias("parent_txn"), F.col("o_orderdate").alias("run_time"),
    )


@query("as_of_snapshot", f"""
SELECT v.id, v.table_name, 2 AS txn FROM {VERSION_SQL} v WHERE v.id % 2 = 0""")
def as_of_snapshot(t: Tables):
    return cat.as_of(derived.versions(t), _links(t), 1, 2).select("id", "table_name", "txn")


@query("latest_snapshot", f"""
SELECT v.id, v.table_name, 3 AS txn FROM {VERSION_SQL} v WHERE v.id % 3 = 0""")
def latest_snapshot(t: Tables):
    return cat.as_of(derived.versions(t), _links(t), 1, 99).select("id", "table_name", "txn")


@query("previous_version", f"""
SELECT id, server, table_name, lag(id) OVER w AS prev_id, lag(data_length) OVER w AS prev_data_length FROM {VERSION_SQL}
WINDOW w AS (PARTITION BY server, database_name, table_name ORDER BY id)""")
def previous_version(t: Tables):
    out = cat.with_previous(derived.versions(t), ["data_length"], block=ordered.id_block("id"))
    return out.select("id", "server", "table_name", "prev_id", "prev_data_length")


STATUS_CASE = """CASE WHEN database_name IS NULL AND table_name IS NULL AND data_length IS NULL AND index_length IS NULL AND data_free IS NULL THEN 'unreachable'
  WHEN data_length IS NULL AND index_length IS NULL AND data_free IS NULL THEN 'deleted'
  WHEN pid IS NULL OR (pd IS NULL AND pi IS NULL AND pf IS NULL) THEN 'new'
  WHEN pd IS DISTINCT FROM data_length OR pi IS DISTINCT FROM index_length THEN 'changed' ELSE 'unchanged' END"""
STATUS_SQL = f"""(SELECT *, {STATUS_CASE} AS status FROM (SELECT *, lag(id) OVER w AS pid, lag(data_length) OVER w AS pd, lag(index_length) OVER w AS pi, lag(data_free) OVER w AS pf
  FROM {VERSION_SQL} WINDOW w AS (PARTITION BY server, database_name, table_name ORDER BY id)))"""


def _volume_status(t: Tables):
    return cat.version_status(
        derived.versions(t), ["data_length", "index_length"], ["data_length", "index_length", "data_free"],
        block=ordered.id_block("id"),
    )


@query("version_status", f"SELECT id, server, table_name, status FROM {STATUS_SQL}")
def version_status(t: Tables):
    return _volume_status(t).select("id", "server", "table_name", "status")


@query("definition_status", f"""
SELECT id, CASE WHEN database_name IS NULL AND create_syntax IS NULL THEN 'unreachable' WHEN create_syntax IS NULL THEN 'deleted'
  WHEN pid IS NULL OR pc IS NULL THEN 'new' WHEN pc <> create_syntax THEN 'changed' ELSE 'unchanged' END AS status
FROM (SELECT *, lag(id) OVER w AS pid, lag(create_syntax) OVER w AS pc FROM {VERSION_SQL} WINDOW w AS (PARTITION BY server, database_name, table_name ORDER BY id))""")
def definition_status(t: Tables):
    out = cat.version_status(derived.versions(t), ["create_syntax"], ["create_syntax"], block=ordered.id_block("id"))
    return out.select("id", "status")


@query("change_counts", f"""
SELECT count(*) FILTER (status = 'unreachable') AS unreachable, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'new') AS new,
  count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status <> 'unchanged') > 0 AS send FROM {STATUS_SQL}""")
def change_counts(t: Tables):
    return cat.change_counts(_volume_status(t))


@query("change_alert", f"""
SELECT id, status, 'CRITICAL' AS alert FROM {STATUS_SQL} WHERE status <> 'unchanged' AND regexp_matches(concat_ws('.', server, database_name, table_name), '^s1\\.db1|t9$')""")
def change_alert(t: Tables):
    from fleetlens.operators import checks

    return checks.change_alert(_volume_status(t), [r"^s1\.db1", r"t9$"]).select("id", "status", "alert")


@query("version_history", f"""
SELECT id, run_time FROM {VERSION_SQL} WHERE table_name = 't370' AND server = 's0' AND id <= 14000 AND run_time >= {SINCE}""")
def version_history(t: Tables):
    out = cat.history(derived.versions(t), {"table_name": "t370", "server": "s0"}, 14000, _ts("1997-01-01"))
    return out.select("id", "run_time")


@query("last_versions", f"""
SELECT server, table_name, max(id) AS id, arg_max(data_length IS NULL, id) AS gone FROM {VERSION_SQL} WHERE run_time <= {SINCE} GROUP BY server, database_name, table_name""")
def last_versions(t: Tables):
    out = cat.last_versions(derived.versions(t), at=_ts("1997-01-01"))
    return out.select("server", "table_name", "id", F.col("data_length").isNull().alias("gone"))


# The catalogue seen now: tables of customers not divisible by 7; every 11th changed its text.
@query("catalog_changes", f"""
WITH last AS (SELECT server, database_name, table_name, arg_max(coalesce(create_syntax, ''), id) AS old FROM {VERSION_SQL} WHERE table_name IS NOT NULL GROUP BY 1, 2, 3),
cur AS (SELECT 's' || c_custkey % 5 AS server, 'db' || c_custkey % 20 AS database_name, 't' || c_custkey AS table_name,
   'CREATE ' || CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE 'O' END AS txt FROM customer WHERE c_custkey % 7 > 0)
SELECT coalesce(cur.table_name, last.table_name) AS table_name, txt AS create_syntax, nullif(old, '') AS old_create_syntax,
  CASE WHEN txt IS NULL THEN 'deleted' WHEN old IS NULL OR old = '' THEN 'new' ELSE 'changed' END AS change
FROM cur FULL JOIN last USING (server, database_name, table_name)
WHERE (txt IS NULL AND old <> '') OR (txt IS NOT NULL AND (old IS NULL OR old = '' OR old <> txt))""")
def catalog_changes(t: Tables):
    v = derived.versions(t).filter("table_name is not null").select("server", "database_name", "table_name", "id", "create_syntax")
    c = F.col("c_custkey")
    cur = t.customer.filter("c_custkey % 7 > 0").select(
        F.concat(F.lit("s"), c % 5).alias("server"), F.concat(F.lit("db"), c % 20).alias("database_name"), F.concat(F.lit("t"), c).alias("table_name"),
        F.when(c % 11 == 0, "CREATE X").otherwise("CREATE O").alias("create_syntax"),
    )
    out = cat.catalog_changes(cur, cat.last_versions(v))
    return out.select("table_name", "create_syntax", "old_create_syntax", "change")


@query("privilege_changes", """
WITH g AS (SELECT c_custkey AS k, 's' || c_nationkey AS server, c_name AS usr, c_custkey % 3 AS a, (c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END) % 3 AS b FROM customer),
f AS (SELECT *, CASE a WHEN 0 THEN 'Insert_priv,Select_priv' WHEN 1 THEN 'Select_priv' ELSE 'Delete_priv' END AS fa,
   CASE b WHEN 0 THEN 'Insert_priv,Select_priv' WHEN 1 THEN 'Select_priv' ELSE 'Delete_priv' END AS fb FROM g),
o AS (SELECT 16 AS permtype, server, usr AS "User", NULL AS "Db", CASE WHEN k % 5 > 0 THEN fa END AS flags, CASE WHEN k % 6 > 0 THEN fb END AS old_flags FROM f
 UNION ALL SELECT 64, server, usr, 'db1', CASE WHEN k % 6 > 0 THEN fb END, CASE WHEN k % 5 > 0 THEN fa END FROM f)
SELECT permtype, server, "User", "Db", flags, old_flags, CASE WHEN flags IS NULL THEN 'deleted' WHEN old_flags IS NULL THEN 'new' ELSE 'changed' END AS change
FROM o WHERE flags IS DISTINCT FROM old_flags""")
def privilege_changes(t: Tables):
    def rows(shift: bool):
        k = F.col("c_custkey") + (F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0) if shift else F.lit(0))
        names = F.when(k % 3 == 0, "Select,Insert").when(k % 3 == 1, "Select").otherwise("Delete")
        return t.customer.select(
            "c_custkey", F.concat(F.lit("s"), "c_nationkey").alias("server"), F.lit("%").alias("Host"), F.lit("db1").alias("Db"),
            F.col("c_name").alias("User"), pv.flags_from_text(names).alias("flags"),
        )

    a, b = rows(False).filter("c_custkey % 5 > 0"), rows(True).filter("c_custkey % 6 > 0")
    out = cat.privilege_changes(cat.privilege_rows({"global": a, "db": b}), cat.privilege_rows({"global": b, "db": a}))
    return out.select(
        "permtype", "server", "User", "Db", F.array_join("flags", ",").alias("flags"), F.array_join("old_flags", ",").alias("old_flags"), "change")


@query("snapshot_write", f"""
WITH l AS (SELECT * FROM {LINKS_SQL}), w AS (SELECT 1000000 + o_orderkey AS new_id, o_orderkey AS old_id FROM orders WHERE o_orderkey % 12 = 0)
SELECT 1 AS collector_run_id, statistic_id, 4 AS txn, NULL AS parent_txn FROM l WHERE txn = 3 AND statistic_id % 12 > 0
UNION ALL SELECT 1, new_id, 4, 3 FROM w""")
def snapshot_write(t: Tables):
    written = t.orders.filter("o_orderkey % 12 = 0").select((F.col("o_orderkey") + 1000000).alias("new_id"), F.col("o_orderkey").alias("old_id"))
    return cat.snapshot_rows(_links(t), written, 1, "2024-01-01").select("collector_run_id", "statistic_id", "txn", "parent_txn")


@query("snapshot_difference", """
SELECT o_orderkey AS statistic_id, 'removed' AS side FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, 'added' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 > 0""")
def snapshot_difference(t: Tables):
    links = _links(t)
    return cat.snapshot_difference(links.filter("txn = 2"), links.filter("txn = 3"))


@query("unreachable_markers", f"""
SELECT DISTINCT c.server FROM (SELECT 's' || c_nationkey AS server FROM customer) c WHERE server NOT IN
  (SELECT server FROM (SELECT server, arg_max(table_name IS NULL AND data_length IS NULL, id) AS u FROM {VERSION_SQL} GROUP BY 1) WHERE u)""")
def unreachable_markers(t: Tables):
    v = derived.versions(t).groupBy("server").agg(
        F.max_by(F.col("table_name").isNull() & F.col("data_length").isNull(), "id").alias("unreachable")
    )
    hosts = t.customer.select(F.concat(F.lit("s"), "c_nationkey").alias("server")).distinct()
    return cat.unreachable_markers(hosts, v)


@query("size_rollup", f"""
WITH v AS (SELECT * FROM {VERSION_SQL} WHERE NOT (database_name IS NULL AND table_name IS NULL AND data_length IS NULL AND index_length IS NULL))
SELECT server, NULL AS database_name, nullif(CAST(sum(data_length) AS BIGINT), 0) AS data_length, nullif(CAST(sum(index_length) AS BIGINT), 0) AS index_length FROM v GROUP BY 1
UNION ALL SELECT server, database_name, nullif(CAST(sum(data_length) AS BIGINT), 0), nullif(CAST(sum(index_length) AS BIGINT), 0) FROM v GROUP BY 1, 2""")
def size_rollup(t: Tables):
    return cat.sizes(derived.versions(t))


@query("cached_sizes", f"""
WITH v AS (SELECT *, coalesce(data_length, 0) + coalesce(index_length, 0) AS size FROM {VERSION_SQL} WHERE database_name IS NOT NULL)
SELECT 'server' AS level, server, NULL AS database_name, NULL AS table_name, CAST(sum(size) AS BIGINT) AS cached_size FROM v GROUP BY server
UNION ALL SELECT 'schema', server, database_name, NULL, CAST(sum(size) AS BIGINT) FROM v GROUP BY server, database_name
UNION ALL SELECT 'table', server, database_name, table_name, CAST(sum(size) AS BIGINT) FROM v GROUP BY server, database_name, table_name""")
def cached_sizes(t: Tables):
    return cat.cached_sizes(derived.versions(t))


GROWTH_SQL = f"""
WITH v AS (SELECT *, data_length + index_length AS size FROM {VERSION_SQL} WHERE run_time > {SINCE} AND table_name IS NOT NULL),
g AS (SELECT server, database_name, table_name, arg_min(coalesce(size, -1), id) AS f, arg_max(coalesce(size, -1), id) AS l FROM v GROUP BY 1, 2, 3),
tg AS (SELECT * FROM g WHERE f >= 0 AND l >= 0)"""


def _growth(t: Tables):
    v = derived.versions(t).filter("table_name is not null")
    return cat.growth(v, _ts("1997-01-01"), F.col("data_length") + F.col("index_length"))


@query("table_growth", GROWTH_SQL + """
SELECT server, table_name, f AS first_size, l AS last_size, l - f AS change, round(CASE WHEN f <> 0 THEN (l - f) / f END, 8) AS growth FROM tg""")
def table_growth(t: Tables):
    return rounded(_growth(t).drop("database_name"), 8, "growth")


@query("fast_growing_tables", GROWTH_SQL + """
SELECT server, table_name, round((l - f) / f, 8) AS growth FROM tg WHERE f <> 0 AND (l - f) / f > 0.5 ORDER BY growth DESC, server, table_name LIMIT 50""")
def fast_growing_tables(t: Tables):
    g = rounded(_growth(t), 8, "growth").filter("growth > 0.5")
    return cat.top_by_size(g, 50, "growth", tie=("server", "table_name")).select("server", "table_name", "growth")


@query("database_growth", GROWTH_SQL + """
SELECT server, database_name, CAST(sum(f) AS BIGINT) AS first_size, CAST(sum(l) AS BIGINT) AS last_size, CAST(sum(l - f) AS BIGINT) AS change,
  round(CASE WHEN sum(f) <> 0 THEN sum(l - f) / sum(f) END, 8) AS growth FROM tg GROUP BY 1, 2""")
def database_growth(t: Tables):
    return rounded(cat.database_growth(_growth(t)), 8, "growth")


@query("top_tables", f"""
SELECT server, table_name, CAST(sum(coalesce(data_length, 0) + coalesce(index_length, 0)) AS BIGINT) AS cached_size FROM {VERSION_SQL}
WHERE database_name IS NOT NULL AND server = 's1' GROUP BY 1, database_name, 2 ORDER BY 3 DESC, 2 LIMIT 10""")
def top_tables(t: Tables):
    sizes = cat.cached_sizes(derived.versions(t)).filter("level = 'table'")
    return cat.top_by_size(sizes, 10, server="s1", tie=("table_name",)).select("server", "table_name", "cached_size")


@query("report_query", f"""
SELECT server, count(*) AS n, max(data_length) AS biggest FROM {VERSION_SQL} WHERE run_time >= {SINCE} AND data_length > 0 GROUP BY 1 ORDER BY n DESC, server LIMIT 3""")
def report_query(t: Tables):
    return cat.report_query(
        derived.versions(t), select=["count(*) AS n", "max(data_length) AS biggest"], where="data_length > 0",
        since=_ts("1997-01-01"), group=["server"], order=[F.col("n").desc(), "server"], limit=3,
    )


ROLL_SQL = """
WITH b AS (SELECT event_type, floor(epoch(ts) / 3600) AS s, avg(value) AS v FROM events GROUP BY 1, 2),
f AS (SELECT unnest([{'f': 1, 'k': 172800}, {'f': 2, 'k': 1209600}, {'f': 4, 'k': 2678400}, {'f': 8, 'k': 15811200}, {'f': 16, 'k': 31622400}, {'f': 32, 'k': 63158400}]) AS a),
x AS (SELECT event_type, a.f AS factor, a.k AS keep, floor(s / a.f) AS bk, v FROM b, f),
y AS (SELECT event_type, factor, bk, count(*) AS n, avg(v) AS average, max(v) AS mx, min(v) AS mn FROM x
  WHERE (bk + 1) * factor * 3600 > epoch(TIMESTAMP '2024-01-30') - keep GROUP BY 1, 2, 3)
SELECT event_type, factor, to_timestamp(bk * factor * 3600)::TIMESTAMP AS bucket, round(CASE WHEN n >= factor * 0.75 THEN average END, 9) AS average,
  round(CASE WHEN n >= factor * 0.75 THEN mx END, 9) AS max, round(CASE WHEN n >= factor * 0.75 THEN mn END, 9) AS min FROM y"""


@query("consolidated_series", ROLL_SQL)
def consolidated_series(t: Tables):
    out = cat.consolidate(t.events, ["event_type"], "ts", "value", 3600, "2024-01-30", cat.ARCHIVES)
    return rounded(out.withColumn("bucket", when_ts("bucket")), 9, "average", "max", "min")


@query("size_series", f"""
WITH v AS (SELECT * FROM {VERSION_SQL} WHERE NOT (database_name IS NULL AND table_name IS NULL AND data_length IS NULL AND index_length IS NULL)),
s AS (SELECT server, NULL AS database_name, NULL AS table_name, run_time, CAST(sum(data_length) AS BIGINT) AS data_length, CAST(sum(index_length) AS BIGINT) AS index_length FROM v GROUP BY 1, 4
UNION ALL SELECT server, database_name, NULL, run_time, CAST(sum(data_length) AS BIGINT), CAST(sum(index_length) AS BIGINT) FROM v GROUP BY 1, 2, 4
UNION ALL SELECT server, database_name, table_name, run_time, CAST(sum(data_length) AS BIGINT), CAST(sum(index_length) AS BIGINT) FROM v GROUP BY 1, 2, 3, 4)
SELECT * FROM s WHERE NOT (database_name IS NULL AND month(run_time) < 6) AND NOT (table_name IS NOT NULL AND server = 's1' AND run_time > TIMESTAMP '1997-03-01')""")
def size_series(t: Tables):
    v = derived.versions(t)
    none = F.lit(None).cast("string")
    loaded = v.filter(F.month("run_time") < 6).select("server", none.alias("database_name"), none.alias("table_name"), "run_time").distinct()
    ends = v.filter("server = 's1' and table_name is not null").select("server", "database_name", "table_name", _ts("1997-03-01").alias("last_run")).distinct()
    return cat.size_series(v, loaded, ends)


@query("series_summary", f"""
SELECT server, arg_max(value, (ts, event_id)) AS last, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM {derived.STATUS_SQL}
WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1""")
def series_summary(t: Tables):
    s = derived.status_values(t)
    return rounded(cat.series_summary(s, ["server"], "ts", "value", _ts("2024-01-10")), 6, "avg")


@query("counter_deltas", f"""
SELECT server, name, event_id, round(value - lag(value) OVER (PARTITION BY server, name ORDER BY event_id), 4) AS delta FROM {derived.STATUS_SQL}""")
def counter_deltas(t: Tables):
    s = derived.status_values(t).drop("ts")
    out = cat.counter_deltas(s, ["server", "name"], "event_id", "value", ordered.id_block("event_id"))
    return rounded(out.drop("value"), 4, "delta")


@query("version_diff_pairs", f"""
SELECT id, create_syntax AS new_text, lag(create_syntax) OVER (PARTITION BY server, database_name, table_name ORDER BY id) AS old_text FROM {VERSION_SQL}""")
def version_diff_pairs(t: Tables):
    out = cat.with_previous(derived.versions(t), ["create_syntax"], block=ordered.id_block("id"))
    return out.select("id", F.col("create_syntax").alias("new_text"), F.col("prev_create_syntax").alias("old_text"))
