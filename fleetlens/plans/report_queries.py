"""Catalogue reports over derived rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import reports
from fleetlens.plans import derived
from fleetlens.plans.derived import CATALOG_SQL, PROC_SQL, STATUS_SQL
from fleetlens.plans.registry import Tables, query, rounded


@query("capacity", """
WITH m AS (SELECT 'l_orderkey' AS column_name, 'int' AS column_type, max(l_orderkey) AS v, 2147483647 AS lim FROM lineitem
UNION ALL SELECT 'l_linenumber', 'tinyint', max(l_linenumber), 127 FROM lineitem UNION ALL SELECT 'l_suppkey', 'tinyint(3) unsigned', max(l_suppkey), 255 FROM lineitem
UNION ALL SELECT 'l_partkey', 'smallint(5) unsigned zerofill', max(l_partkey), 65535 FROM lineitem)
SELECT column_name, column_type, CAST(v AS VARCHAR) AS max_value, CAST(lim AS VARCHAR) AS type_limit, round(v / lim * 100, 0) AS pct FROM m WHERE round(v / lim * 100, 0) > 2""")
def capacity(t: Tables):
    types = {"l_orderkey": "int", "l_linenumber": "tinyint", "l_suppkey": "tinyint(3) unsigned", "l_partkey": "smallint(5) unsigned zerofill"}
    out = reports.capacity(t.lineitem, types, 2)
    return out.withColumns({c: F.col(c).cast("string") for c in ("max_value", "type_limit")})


FRAG_SQL = f"""
WITH f AS (SELECT *, data_length + index_length AS used FROM {CATALOG_SQL} WHERE lower(engine) = 'innodb' AND data_free / 1048576 >= 1 AND (data_length + index_length) / 1048576 BETWEEN 8 AND 12),
k AS (SELECT database_name, table_name, round(data_length / 1024, 0) AS data_kib, round(index_length / 1024, 0) AS index_kib, round(data_free / 1024, 0) AS free_kib,
  round((used + data_free) / 1024, 0) AS current_kib, round(used / 1024, 0) AS expected_kib FROM f)"""


@query("fragmentation", FRAG_SQL + " SELECT * FROM k")
def fragmentation(t: Tables):
    return reports.fragmentation(derived.catalog(t), 1, 8, 12)


@query("fragmentation_total", FRAG_SQL + """
SELECT count(*) AS tables, sum(data_kib) AS data_kib, sum(index_kib) AS index_kib, sum(free_kib) AS free_kib, sum(current_kib) AS current_kib, sum(expected_kib) AS expected_kib FROM k""")
def fragmentation_total(t: Tables):
    return reports.fragmentation_total(reports.fragmentation(derived.catalog(t), 1, 8, 12))


@query("table_ratios", """
WITH s AS (SELECT l_suppkey, sum(l_quantity) AS live, sum(l_linenumber) AS dead, sum(l_partkey) AS hits, sum(l_orderkey) AS reads FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(dead * 100 / (live + dead), 6) AS dead_pct, round(hits * 100 / (hits + reads), 6) AS hit_pct,
  round(live * 100 / (live + dead), 6) AS read_pct, round(dead * 100 / live, 6) AS hot_pct FROM s""")
def table_ratios(t: Tables):
    s = t.lineitem.select(
        "l_suppkey", F.col("l_quantity").alias("live"), F.col("l_linenumber").alias("dead"), F.col("l_partkey").alias("hits"), F.col("l_orderkey").alias("reads"),
        F.col("l_quantity").alias("read_rows"), F.col("l_linenumber").alias("written_rows"), F.col("l_quantity").alias("updates"), F.col("l_linenumber").alias("hot_updates"),
    )
    return rounded(reports.table_ratios(s, ["l_suppkey"]), 6, "dead_pct", "hit_pct", "read_pct", "hot_pct")


@query("duplicate_definitions", """
WITH g AS (SELECT p_brand, p_type, p_size, count(*) AS copies FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT part.p_brand, part.p_type, part.p_size, p_partkey, copies FROM part JOIN g ON part.p_brand = g.p_brand AND part.p_type = g.p_type AND part.p_size = g.p_size""")
def duplicate_definitions(t: Tables):
    return reports.duplicate_definitions(t.part, ["p_brand", "p_type", "p_size"], "p_partkey")


@query("index_summary", """
SELECT c_custkey AS table_name, count(*) FILTER (o_orderkey % 4 = 0) AS single_column, count(*) FILTER (o_orderkey % 4 > 0) AS multi_column, count(o_orderkey) AS indexes
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def index_summary(t: Tables):
    tables = t.customer.select(F.col("c_custkey").alias("table_name"))
    indexes = t.orders.select(F.col("o_custkey").alias("table_name"), (F.col("o_orderkey") % 4 + 1).alias("n_columns"))
    return reports.index_summary(tables, indexes)


@query("bloat_estimate", """
WITH s AS (SELECT l_suppkey AS tbl, sum((1 - l_discount) * l_quantity) AS width, max(l_discount) AS maxnull, count(*) FILTER (l_discount <> 0) AS nullable FROM lineitem GROUP BY 1),
h AS (SELECT *, width + 23 + 4 - 23 % 4 AS dh, 23 + 1 + floor(nullable / 8) AS nh FROM s),
n AS (SELECT *, maxnull * (nh + 4 - CASE WHEN nh % 4 = 0 THEN 4 ELSE nh % 4 END) AS nh2, dh + 4 - CASE WHEN dh % 4 = 0 THEN 4 ELSE dh % 4 END AS per_row FROM h),
r AS (SELECT s_suppkey AS tbl, 1000 * (s_suppkey + 1) AS rws, 10 * (s_nationkey + 1) AS pages FROM supplier),
e AS (SELECT r.tbl, pages, ceil(rws * (per_row + nh2 + 4) / 8172e0) AS exp, ceil((rws / 2) * (dh - 12) / 8172e0) AS iexp FROM r JOIN n ON r.tbl = n.tbl)
SELECT tbl AS table_name, CASE WHEN exp = 0 THEN 0 ELSE round(pages / exp, 1) END AS table_bloat,
  CASE WHEN tbl % 3 = 0 OR iexp = 0 THEN 0 ELSE round(pages * 2 / iexp, 1) END AS index_bloat FROM e""")
def bloat_estimate(t: Tables):
    stats = t.lineitem.select(F.col("l_suppkey").alias("table_name"), F.col("l_discount").alias("null_frac"), F.col("l_quantity").alias("avg_width"))
    rel = t.supplier.select(
        F.col("s_suppkey").alias("table_name"), (1000 * (F.col("s_suppkey") + 1)).alias("rows"), (10 * (F.col("s_nationkey") + 1)).alias("pages"))
    idx = rel.filter("table_name % 3 > 0").select("table_name", F.lit("i").alias("index_name"), (F.col("rows") / 2).alias("rows"), (F.col("pages") * 2).alias("pages"))
    return reports.bloat(rel, stats, idx).select("table_name", "table_bloat", "index_bloat")


@query("schema_sizes", f"""
SELECT server, database_name, count(*) AS members, CAST(sum(data_length) AS BIGINT) AS data_length, CAST(sum(index_length) AS BIGINT) AS index_length FROM {CATALOG_SQL} GROUP BY 1, 2""")
def schema_sizes(t: Tables):
    return reports.totals(derived.catalog(t), ["server", "database_name"], ["data_length", "index_length"])


@query("instance_size", f"""
SELECT count(*) AS members, CAST(sum(data_length) AS BIGINT) AS data_length, CAST(sum(index_length) AS BIGINT) AS index_length FROM {CATALOG_SQL}""")
def instance_size(t: Tables):
    return reports.totals(derived.catalog(t), [], ["data_length", "index_length"])


@query("with_grand_total", """
SELECT n_name, c_custkey, (SELECT count(*) FROM customer) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def with_grand_total(t: Tables):
    return reports.with_grand_total(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey"))


@query("cluster_counters", """
SELECT CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, 10000000 AS max_backends,
  round(sum(l_suppkey) * 100 / 10000000, 4) AS backends_pct FROM lineitem""")
def cluster_counters(t: Tables):
    out = reports.cluster_counters(t.lineitem, ["l_linenumber", "l_partkey"], "l_suppkey", 10000000)
    return rounded(out, 4, "backends_pct")


@query("lock_counts", f"""
SELECT server, count(*) FILTER (command = 'Query') AS query, count(*) FILTER (command = 'Sleep') AS sleep, 0 AS accesssharelock FROM {PROC_SQL} GROUP BY 1""")
def lock_counts(t: Tables):
    return reports.lock_counts(derived.processes(t), ["server"], ("Query", "Sleep", "AccessShareLock"), "command")


@query("lock_counts_by_mode", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_id % 4 <> 2 OR event_id % 12 = 2 GROUP BY 1""")
def lock_counts_by_mode(t: Tables):
    kind = F.when(F.col("event_id") % 12 == 2, None).otherwise(F.element_at(F.array(*map(F.lit, ("relation", "tuple", "virtualxid", "page"))), (F.col("event_id") % 4 + 1).cast("int")))
    return reports.lock_counts(t.events.withColumn("locktype", kind), ["user_id"], ("click", "view"), "event_type", "locktype")


@query("lock_type_counts", """
SELECT event_type, ['relation', 'tuple', 'virtualxid', 'page'][event_id % 4 + 1] AS locktype, count(*) AS cnt FROM events GROUP BY 1, 2""")
def lock_type_counts(t: Tables):
    kind = F.element_at(F.array(*map(F.lit, ("relation", "tuple", "virtualxid", "page"))), (F.col("event_id") % 4 + 1).cast("int"))
    return reports.lock_type_counts(t.events.withColumn("locktype", kind), ["event_type"])


@query("phrase_counts", """
WITH l AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT file, count(*) FILTER (contains(line, 'the')) AS the, count(*) FILTER (contains(line, 'license')) AS license FROM l GROUP BY 1""")
def phrase_counts(t: Tables):
    lines = t.documents.select(F.col("source").alias("file"), F.explode(F.split("text", "\n")).alias("value"))
    return reports.phrase_counts(lines, ["the", "license"])


@query("highest_metrics", f"SELECT server, name, max(value) AS value FROM {STATUS_SQL} GROUP BY 1, 2")
def highest_metrics(t: Tables):
    return reports.highest(derived.status_values(t), ["server", "name"])


@query("merge_metrics", """
WITH a AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, event_type, min(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.v, a.v) AS value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def merge_metrics(t: Tables):
    a = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    b = t.events.filter("user_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    return reports.merge_metrics(a, b, ["user_id", "event_type"])


@query("size_candidates", """
SELECT l_suppkey, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS scans FROM lineitem GROUP BY 1 HAVING count(*) > 600 AND sum(l_linenumber) > 2400""")
def size_candidates(t: Tables):
    s = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_linenumber").alias("scans"))
    return reports.size_candidates(s, 600, 2400)


@query("largest_tables", """
SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2 ORDER BY balance DESC, n_name LIMIT 5""")
def largest_tables(t: Tables):
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    x = x.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return x.orderBy(F.col("balance").desc(), "n_name").limit(5)


@query("outer_catalog_join", """
SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1""")
def outer_catalog_join(t: Tables):
    s = t.supplier.filter("s_acctbal > 5000")
    return t.nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("exclude_views", f"""
SELECT id FROM {CATALOG_SQL} c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 10 = c.id)""")
def exclude_views(t: Tables):
    views = t.supplier.select((F.col("s_suppkey") * 10).alias("id"))
    return derived.catalog(t).join(views, "id", "left_anti").select("id")
