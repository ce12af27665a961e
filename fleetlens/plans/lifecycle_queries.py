"""Partitions, retention, pruning, merging, upserts, masking and generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import numbers
from fleetlens.operators import digest as dg
from fleetlens.operators import lifecycle as lc
from fleetlens.operators import masking, ordered
from fleetlens.plans.registry import Tables, query, rounded, when_ts

PARTS_SQL = """(SELECT 'p' || (year(d) - 1994) * 1 AS name, d AS bound FROM (SELECT DISTINCT date_trunc('year', o_orderdate) AS d FROM orders))"""


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _year_parts(t: Tables, maxvalue: bool = True):
    """One range partition per year of order dates, bound at its first day."""
    p = t.orders.select(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("bound")).distinct()
    p = p.select(F.concat(F.lit("p"), (F.year("bound") - 1994).cast("string")).alias("name"), "bound")
    if not maxvalue:
        return p
    top = p.agg(F.lit("pmax").alias("name"), F.lit(None).cast("timestamp_ntz").alias("bound"))
    return p.unionByName(top)


@query("assign_partition", f"""
SELECT o_orderkey, coalesce((SELECT arg_min(name, bound) FROM {PARTS_SQL} p WHERE o.o_orderdate < p.bound), 'pmax') AS partition FROM orders o""")
def assign_partition(t: Tables):
    return lc.assign_partition(t.orders, _year_parts(t), "o_orderdate").select("o_orderkey", "partition")


@query("plan_partitions", """
WITH l AS (SELECT o_custkey, max(o_orderdate)::DATE AS last, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1),
x AS (SELECT o_custkey, last, n, unnest(range(0, 400)) AS i FROM l)
SELECT o_custkey, 'p' || (n + i) AS name, strftime(last + to_days(CAST(7 * (i + 1) AS INTEGER)), '%Y-%m-%d') AS bound FROM x
WHERE i < 10 AND last + to_days(CAST(7 * i AS INTEGER)) < DATE '2000-01-01'""")
def plan_partitions(t: Tables):
    days = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("bound")).distinct()
    # Number the bounds of each table in order.
    block = F.year("bound").cast("long")
    p = ordered.running_sum(days, {"n": F.lit(1)}, ["bound"], block, ["o_custkey"])
    p = p.select("o_custkey", F.concat(F.lit("p"), (F.col("n") - 1).cast("string")).alias("name"), "bound")
    out = lc.plan_partitions(p, "2000-01-01", "7 days", keys=["o_custkey"], limit=10)
    return out.select("o_custkey", "name", F.date_format("bound", "yyyy-MM-dd").alias("bound"))


@query("split_maxvalue", """
WITH l AS (SELECT date_trunc('year', max(o_orderdate))::DATE AS last FROM orders), x AS (SELECT last, unnest(range(0, 40)) AS i FROM l),
a AS (SELECT 'p' || (year(last) - 1994 + 1 + i) AS name, last + to_months(CAST(i + 1 AS INTEGER)) AS b, i FROM x WHERE last + to_months(CAST(i AS INTEGER)) < DATE '2002-05-10')
SELECT name, strftime(b, '%Y-%m-%d') AS bound, true AS reorganize FROM a UNION ALL SELECT 'p' || (year(last) - 1994 + 2 + (SELECT max(i) FROM a)), NULL, true FROM l""")
def split_maxvalue(t: Tables):
    parts = _year_parts(t).withColumn("bound", F.col("bound").cast("date"))
    out = lc.plan_partitions(parts, "2002-05-10", "1 month")
    return out.select("name", F.date_format("bound", "yyyy-MM-dd").alias("bound"), "reorganize")


@query("partitions_before", f"""
SELECT name, strftime(bound, '%Y-%m-%d') AS bound FROM {PARTS_SQL} WHERE bound < TIMESTAMP '1998-06-01' ORDER BY bound LIMIT 2""")
def partitions_before(t: Tables):
    out = lc.partitions_before(_year_parts(t), _ts("1998-06-01"), 2)
    return out.withColumn("bound", F.date_format("bound", "yyyy-MM-dd"))


@query("partition_archive", """
SELECT 'archived' AS side, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
UNION ALL SELECT 'kept', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'""")
def partition_archive(t: Tables):
    parts = _year_parts(t)
    rows = lc.assign_partition(t.orders, parts, "o_orderdate")
    gone, kept = lc.split_by_partitions(rows, lc.partitions_before(parts, _ts("1997-06-01")))

    def summary(df, side):
        return df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    return summary(gone, "archived").unionByName(summary(kept, "kept"))


@query("purge_older", """
SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-01' - INTERVAL 18 MONTH""")
def purge_older(t: Tables):
    return lc.purge_older(t.orders, "o_orderdate", "18m", "1998-12-01").select("o_orderkey")


@query("archive_rows", """
WITH o AS (SELECT o_orderkey, nullif(o_custkey % 10, 3) AS k, o_orderstatus = 'F' AND o_totalprice > 200000 AS hit FROM orders),
a AS (SELECT *, hit AND row_number() OVER (PARTITION BY hit ORDER BY k NULLS FIRST, o_orderkey) <= 100 AS archived FROM o)
SELECT archived, count(*) AS rows, count(DISTINCT o_orderkey) AS orders, count(*) - count(k) AS without_k, CAST(sum(k) AS BIGINT) AS sum_k FROM a GROUP BY 1""")
def archive_rows(t: Tables):
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(3)).alias("k"), "o_orderstatus", "o_totalprice")
    gone, kept = lc.split_rows(rows, "o_orderstatus = 'F' AND o_totalprice > 200000", 100, ["k"])
    both = gone.withColumn("archived", F.lit(True)).unionByName(kept.withColumn("archived", F.lit(False)))
    return both.groupBy("archived").agg(
        F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("orders"), F.count_if(F.col("k").isNull()).alias("without_k"), F.sum("k").alias("sum_k"))


@query("archive_tables_by_age", """
SELECT DISTINCT 'log_' || strftime(o_orderdate, '%Y%m%d') AS table_name FROM orders WHERE o_orderdate < TIMESTAMP '1998-12-01' - INTERVAL 90 WEEK""")
def archive_tables_by_age(t: Tables):
    names = t.orders.select(F.date_format("o_orderdate", "'log_'yyyyMMdd").alias("table_name")).distinct()
    return lc.archive_by_name_age(names, "table_name", "log_%Y%m%d", "90w", "1998-12-01").select("table_name")


@query("rotation_plan", """
SELECT DISTINCT 't' || o_custkey AS table_name, 't' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') AS rotated FROM orders WHERE o_orderkey % 3 > 0
  AND 't' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') NOT IN (SELECT 't' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') FROM orders WHERE o_orderkey % 3 = 0)""")
def rotation_plan(t: Tables):
    name = F.concat(F.lit("t"), F.col("o_custkey").cast("string"))
    wanted = t.orders.filter("o_orderkey % 3 > 0").select(name.alias("table_name"), "o_orderdate").distinct()
    have = t.orders.filter("o_orderkey % 3 = 0").select(F.concat(name, F.date_format("o_orderdate", "_yyyyMMdd")).alias("table_name")).distinct()
    return lc.rotation_plan(wanted, have, "table_name", "o_orderdate", "_%Y%m%d").select("table_name", "rotated")


@query("prune", """
WITH p AS (SELECT CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey // 2 END AS id FROM orders), c AS (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey // 2 END AS ref FROM lineitem),
k AS (SELECT max(id) AS last FROM (SELECT id FROM p WHERE id IS NOT NULL ORDER BY id LIMIT 1000))
SELECT 'parent' AS side, count(*) AS rows FROM p, k WHERE id IS NULL OR id <= last
UNION ALL SELECT 'child', count(*) FROM c, k WHERE ref IS NULL OR NOT (ref > last AND ref IN (SELECT id FROM p WHERE id IS NOT NULL))
UNION ALL SELECT 'parent of none', count(*) FROM p WHERE id IS NULL
UNION ALL SELECT 'child of none', count(*) FROM c WHERE ref IS NULL OR ref NOT IN (SELECT id FROM p WHERE id IS NOT NULL)""")
def prune(t: Tables):
    parents = t.orders.select(F.when(F.col("o_orderkey") % 11 > 0, F.floor(F.col("o_orderkey") / 2)).alias("id"))
    children = t.lineitem.select(F.when(F.col("l_linenumber") < 7, F.floor(F.col("l_orderkey") / 2)).alias("ref"))
    one = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"))
    kept, (lines,) = lc.prune(parents, [(children, "ref")], "id", 1000)
    bare, (orphans,) = lc.prune(parents, [(children, "ref")], "id", 0)
    return one(kept, "parent").unionByName(one(lines, "child")).unionByName(one(bare, "parent of none")).unionByName(one(orphans, "child of none"))


@query("prune_third", """
WITH k AS (SELECT max(o_custkey) AS last FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS r FROM orders) WHERE r <= (SELECT count(*) // 3 FROM orders))
SELECT 'parent' AS side, count(*) AS rows FROM orders, k WHERE o_custkey <= last UNION ALL SELECT 'child', count(*) FROM customer, k
WHERE NOT (c_custkey > last AND c_custkey IN (SELECT o_custkey FROM orders))""")
def prune_third(t: Tables):
    """A third of a table stays: the cut is found by counting, in blocks far smaller than that."""
    parents = t.orders.select(F.col("o_custkey").alias("id"))
    kept, (rest,) = lc.prune(parents, [(t.customer.select(F.col("c_custkey").alias("ref")), "ref")], "id", parents.count() // 3, block=200)
    one = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"))
    return one(kept, "parent").unionByName(one(rest, "child"))


@query("archive_third", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice, o_orderkey) AS r FROM orders)
SELECT r <= (SELECT count(*) // 3 FROM orders) AS archived, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o GROUP BY 1""")
def archive_third(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    gone, kept = lc.split_rows(rows, "true", rows.count() // 3, ["o_orderstatus", "o_totalprice", "o_orderkey"], block=200)
    both = gone.withColumn("archived", F.lit(True)).unionByName(kept.withColumn("archived", F.lit(False)))
    return both.groupBy("archived").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("child_tables", """
WITH c AS (SELECT p_brand AS table_name, p_type || p_size % 3 AS column_name FROM part)
SELECT DISTINCT table_name, column_name FROM c WHERE table_name <> 'Brand#1' AND column_name = 'SMALL1'
  AND EXISTS (SELECT 1 FROM c x WHERE x.table_name = 'Brand#1' AND x.column_name = 'SMALL1')""")
def child_tables(t: Tables):
    c = t.part.select(F.col("p_brand").alias("table_name"), F.concat("p_type", (F.col("p_size") % 3).cast("string")).alias("column_name")).distinct()
    return lc.children_by_column(c, "Brand#1", "SMALL1").select("table_name", "column_name")


@query("merge_sources", """
WITH x AS (SELECT nullif(o_custkey, 13) AS k, 0 AS n, 'a' || o_orderkey AS src FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT nullif(o_custkey, 13), 1, 'b' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT nullif(c_custkey, 17), 2, 'c' || c_custkey FROM customer)
SELECT k, (array_agg(src ORDER BY n, src))[1] AS src FROM x WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, src FROM x WHERE k IS NULL""")
def merge_sources(t: Tables):
    key = F.nullif("o_custkey", F.lit(13)).alias("k")
    a = t.orders.filter("o_orderkey % 2 = 0").select(key, F.concat(F.lit("a"), "o_orderkey").alias("src"))
    b = t.orders.filter("o_orderkey % 3 = 0").select(key, F.concat(F.lit("b"), "o_orderkey").alias("src"))
    return lc.merge_sources([a, b, t.customer.select(F.nullif("c_custkey", F.lit(17)).alias("k"), F.concat(F.lit("c"), "c_custkey").alias("src"))], ["k"])


@query("without_foreign_keys", """
SELECT c_mktsegment AS database_name, c_name AS table_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000) AND c_custkey NOT IN (SELECT o_orderkey % 100 FROM orders WHERE o_totalprice > 350000)""")
def without_foreign_keys(t: Tables):
    named = t.customer.select("c_custkey", F.col("c_mktsegment").alias("database_name"), F.col("c_name").alias("table_name"))
    child = t.orders.filter("o_totalprice > 350000").join(named, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "database_name", "table_name")
    parent = named.select(F.col("c_custkey").alias("ref"), F.col("database_name").alias("referenced_database_name"), F.col("table_name").alias("referenced_table_name"))
    fks = child.join(parent, F.col("o_orderkey") % 100 == F.col("ref"))
    return lc.without_foreign_keys(named, fks).select("database_name", "table_name")


# --- review, history and hosts ---------------------------------------------------------


def _review(t: Tables):
    """Known classes: even users, every tenth of them reviewed."""
    u = t.events.filter("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    mid = F.lit("2024-01-05").cast("timestamp")
    return u.select(
        F.col("user_id").alias("checksum"), F.concat(F.lit("f"), "user_id").alias("fingerprint"), F.lit("s").alias("sample"),
        F.when(F.col("user_id") % 6 > 0, mid).alias("first_seen"), mid.alias("last_seen"),
        F.when(F.col("user_id") % 10 == 0, "ann").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_on"), F.lit(None).cast("string").alias("comments"),
    )


def _seen(t: Tables):
    return t.events.filter("user_id % 3 = 0").groupBy(F.col("user_id").alias("checksum")).agg(
        F.concat(F.lit("f"), F.first("user_id")).alias("fingerprint"), F.lit("s2").alias("sample"),
        F.min("ts").cast("timestamp").alias("first_seen"), F.max("ts").cast("timestamp").alias("last_seen"),
    )


@query("merge_review", """
WITH s AS (SELECT user_id AS k, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1)
SELECT k AS checksum, 'f' || k AS fingerprint, CASE WHEN k % 2 = 0 THEN 's' ELSE 's2' END AS sample,
  least(CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN TIMESTAMP '2024-01-05' END, CASE WHEN k % 3 = 0 THEN lo END) AS first_seen,
  greatest(CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-01-05' END, CASE WHEN k % 3 = 0 THEN hi END) AS last_seen, CASE WHEN k % 10 = 0 THEN 'ann' END AS reviewed_by
FROM s WHERE k % 2 = 0 OR k % 3 = 0""")
def merge_review(t: Tables):
    out = lc.merge_review(_review(t), _seen(t), "2024-03-01").drop("reviewed_on", "comments")
    return out.withColumns({c: when_ts(c) for c in ("first_seen", "last_seen")})


@query("unreviewed_classes", """
SELECT DISTINCT user_id AS checksum FROM events WHERE user_id % 3 = 0 AND user_id % 10 > 0""")
def unreviewed_classes(t: Tables):
    return lc.unreviewed(_seen(t), _review(t)).select("checksum")


@query("review_marks", """
SELECT DISTINCT user_id AS checksum, CASE WHEN user_id % 4 = 0 THEN 'eve' WHEN user_id % 10 = 0 THEN 'ann' END AS reviewed_by,
  CASE WHEN user_id % 4 = 0 THEN TIMESTAMP '2024-03-02' WHEN user_id % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS reviewed_on FROM events""")
def review_marks(t: Tables):
    users = t.events.select(F.col("user_id").alias("checksum")).distinct()
    at = lambda day: F.lit(day).cast("timestamp").alias("reviewed_on")
    mark = lambda df, who, day: df.select("checksum", F.lit(who).alias("reviewed_by"), at(day), F.lit("seen").alias("comments"))
    done = F.col("checksum") % 10 == 0
    review = users.select(
        "checksum", F.when(done, "ann").alias("reviewed_by"), F.when(done, F.lit("2024-02-01").cast("timestamp")).alias("reviewed_on"), F.lit(None).cast("string").alias("comments"))
    fourth, tenth = users.filter("checksum % 4 = 0"), users.filter(done)
    marks = mark(fourth, "bob", "2024-03-01").unionByName(mark(fourth, "eve", "2024-03-02")).unionByName(mark(tenth, "old", "2024-01-01"))
    return lc.apply_review_marks(review, marks).select("checksum", "reviewed_by", when_ts("reviewed_on").alias("reviewed_on"))


@query("history_rows", """
SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS ts_min, strftime(max(ts), '%Y-%m-%d') AS ts_max, count(value) AS value_cnt, round(sum(value), 4) AS value_sum, max(value) AS value_max,
  count(user_id) AS user_id_cnt, CAST(sum(user_id) AS DOUBLE) AS user_id_sum, CAST(max(user_id) AS DOUBLE) AS user_id_max FROM events GROUP BY 1""")
def history_rows(t: Tables):
    m = dg.metrics(t.events, ["event_type"], ["value", "user_id"])
    span = t.events.groupBy("event_type").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("ts_min"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("ts_max"))
    out = lc.history_rows(m.join(span, "event_type"), "event_type", ["value", "user_id"], "ts_min", "ts_max", kinds=("cnt", "sum", "max"))
    return rounded(out, 4, "value_sum")


@query("replace_history", """
SELECT user_id, event_type, round(CASE WHEN user_id % 3 = 0 THEN sum(value) * 2 ELSE sum(value) END, 4) AS total FROM events GROUP BY 1, 2""")
def replace_history(t: Tables):
    h = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("total"))
    new = h.filter("user_id % 3 = 0").withColumn("total", F.col("total") * 2)
    return rounded(lc.replace_history(h, new, ["user_id", "event_type"]), 4, "total")


HOSTS_SQL = """h AS (SELECT event_type AS checksum, '10.0.0.' || user_id AS host, 'SOURCE' AS type, ts FROM events
 UNION ALL SELECT event_type, '10.0.1.' || event_id % 5, 'DESTINATION', ts FROM events)"""


def host_observations(events):
    e = events.select(
        F.col("event_type").alias("checksum"), F.concat(F.lit("10.0.0."), "user_id").alias("src"),
        F.concat(F.lit("10.0.1."), F.col("event_id") % 5).alias("dst"), "ts",
    )
    return lc.host_rows(e, "checksum", "src", "dst", "ts")


def _hosts(t: Tables):
    return host_observations(t.events)


@query("host_map", f"""
WITH {HOSTS_SQL} SELECT checksum, host, 167772160 + CASE WHEN type = 'SOURCE' THEN CAST(substr(host, 8) AS BIGINT) ELSE 256 + CAST(substr(host, 8) AS BIGINT) END AS ip, type,
  min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY 1, 2, 3, 4""")
def host_map(t: Tables):
    h = _hosts(t).withColumn("ip", numbers.ip_to_long("host"))
    half = h.filter("checksum <> 'click'")
    return lc.merge_hosts(half, h)


@query("host_edges", f"""
WITH {HOSTS_SQL} SELECT DISTINCT CASE WHEN type = 'SOURCE' THEN host ELSE checksum END AS from_node, CASE WHEN type = 'SOURCE' THEN checksum ELSE host END AS to_node, lower(type) AS kind FROM h""")
def host_edges(t: Tables):
    return lc.host_edges(_hosts(t))


@query("queries_with_history", """
WITH h AS (SELECT user_id, max(event_id) AS ts_max, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT c_custkey, ts_max, value FROM customer JOIN h ON c_custkey = user_id""")
def queries_with_history(t: Tables):
    h = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("ts_max"), "value")
    return lc.with_latest_history(t.customer.select("c_custkey"), h, "c_custkey")


@query("insert_if_absent", """
WITH o AS (SELECT nullif(c_custkey, 5) AS id FROM customer), n AS (SELECT nullif(o_orderkey // 2, 7) AS id, 'new' || o_orderkey AS src FROM orders UNION ALL SELECT nullif(c_custkey, 5), 'again' FROM customer)
SELECT id, 'old' AS src FROM o UNION ALL SELECT id, min(src) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id IS NOT DISTINCT FROM n.id) GROUP BY id""")
def insert_if_absent(t: Tables):
    key = F.nullif("c_custkey", F.lit(5)).alias("id")
    new = t.orders.select(F.nullif(F.floor(F.col("o_orderkey") / 2), F.lit(7)).alias("id"), F.concat(F.lit("new"), "o_orderkey").alias("src"))
    return lc.insert_if_absent(t.customer.select(key, F.lit("old").alias("src")), new.unionByName(t.customer.select(key, F.lit("again").alias("src"))), ["id"])


@query("jobs_report", """
WITH q AS (SELECT o_custkey AS job_id, o_orderkey AS query_id, o_totalprice AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 1000 AND c_acctbal < 5000)
SELECT job_id, query_id, t, rank FROM q WHERE rank <= 3""")
def jobs_report(t: Tables):
    jobs = t.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_acctbal").alias("processed"))
    q = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("query_id"))
    master = t.orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_totalprice").alias("t"))
    return lc.jobs_report(jobs, q, master, 1000, 5000, F.col("t").desc(), 3).select("job_id", "query_id", "t", "rank")


@query("top_by", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_by(t: Tables):
    return lc.top_by(t.orders, "o_totalprice", 20, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


# --- masking and generation --------------------------------------------------------------


@query("mask_round_robin", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no match' ELSE ['Ada', 'Bo', 'Cy'][c_custkey % 3 + 1] || ' ' || ['Lane', 'Moss', 'Nash'][c_custkey % 3 + 1] END AS name,
  CASE WHEN c_custkey % 5 = 1 THEN '(555) ' ELSE '555-' END || ['111-2222', '333-4444'][c_custkey % 2 + 1] AS phone FROM (SELECT c_custkey FROM customer)""")
def mask_round_robin(t: Tables):
    c = t.customer.select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, "no match").otherwise(F.concat(F.lit("First"), "c_custkey", F.lit(" Last"), "c_custkey")).alias("name"),
        F.when(F.col("c_custkey") % 5 == 1, "(555) 123-4567").otherwise("555-123-4567").alias("phone"),
    )
    specs = {
        "name": masking.MaskSpec([r"(\w+) (\w+)"], [("Ada", "Lane"), ("Bo", "Moss"), ("Cy", "Nash")], "roundrobin"),
        "phone": masking.MaskSpec(masking.PATTERNS["phonenumber"], [("111-2222",), ("333-4444",)], "roundrobin"),
    }
    # "no match" has two words, so it needs a pattern that it fails.
    specs["name"].patterns = [r"(First\d+) (Last\d+)"]
    return masking.mask(c, specs, ["c_custkey"], rank=F.col("c_custkey"))


@query("mask_unmatched", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Mononym' WHEN c_custkey % 4 = 1 THEN NULL ELSE 'Ada Lane' END AS name FROM customer""")
def mask_unmatched(t: Tables):
    """Values that fit no pattern pass as they are, NULLs too."""
    name = F.when(F.col("c_custkey") % 4 == 0, "Mononym").when(F.col("c_custkey") % 4 > 1, F.concat(F.lit("First"), "c_custkey", F.lit(" Last")))
    return masking.mask(t.customer.select("c_custkey", name.alias("name")), {"name": masking.MaskSpec(masking.PATTERNS["name"], [("Ada", "Lane")])}, ["c_custkey"])


@query("mask_random_properties", """
SELECT c_custkey, true AS changed, true AS same_domain, true AS short_enough FROM customer""")
def mask_random_properties(t: Tables):
    mail = F.concat(F.lit("user.number."), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    c = t.customer.select("c_custkey", mail.alias("email"), mail.alias("old"))
    out = masking.mask(c, {"email": masking.MaskSpec(masking.PATTERNS["email"])}, ["c_custkey"], seed=7)
    return out.select(
        "c_custkey", (F.col("email") != F.col("old")).alias("changed"), F.col("email").endswith("@example.com").alias("same_domain"),
        (F.length("email") <= F.length("old") + 12).alias("short_enough"),
    )


@query("mask_unique", """
SELECT count(*) AS rows, count(*) AS distinct_names FROM customer""")
def mask_unique(t: Tables):
    out = masking.mask_unique(t.customer.select("c_custkey", "c_name"), "c_name", ["c_custkey"], length=2)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("c_name").alias("distinct_names"))


@query("synthetic_table", """
SELECT o_orderkey, o_orderkey + 1 AS a, true AS b_ok, true AS c_ok, true AS w_ok, true AS n_ok FROM orders""")
def synthetic_table(t: Tables):
    spec = {"a": ("int_pk",), "b": ("varchar", 5), "c": ("varchar", 20), "w": ("words", 4), "n": ("integer", 100), "at": ("timestamp",)}
    out = masking.synthetic_table(t.orders.select(F.col("o_orderkey").alias("id")), spec, seed=88953)
    return out.select(
        F.col("id").alias("o_orderkey"), "a", F.col("b").rlike(r"\A[a-zA-Z]{1,5}\z").alias("b_ok"), F.col("c").rlike(r"\A[a-zA-Z]{1,20}\z").alias("c_ok"),
        F.col("w").rlike(r"\A[a-zA-Z]+( [a-zA-Z]+){0,3}\z").alias("w_ok"), F.col("n").between(0, 100).alias("n_ok"),
    )


@query("synthetic_series", """
SELECT count(*) AS rows, true AS monotone FROM orders""")
def synthetic_series(t: Tables):
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    block = ordered.id_block("id")
    s = masking.synthetic_table(ids, {"x": ("linear_integer", 10)}, seed=1, block=block)
    s = ordered.previous(s, ["x"], ["id"], block)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.coalesce(F.col("x") >= F.col("prev_x"), F.lit(True))).alias("monotone"))


@query("document_review", """
SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1, 2""")
def document_review(t: Tables):
    review = t.labels.select(F.col("doc_id").alias("checksum"), F.when(F.col("quality") == 1, "ok").alias("reviewed_by"))
    docs = t.documents.select(F.col("doc_id").alias("checksum"), "source", "lang", "n_chars")
    return lc.unreviewed(docs, review).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


