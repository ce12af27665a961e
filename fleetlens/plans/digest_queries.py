"""Event classes, statistics, selection and timelines over ``events`` and ``lineitem``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fleetlens.functions import histogram as hist
from fleetlens.operators import digest as dg
from fleetlens.operators import lineage, ordered
from fleetlens.plans.registry import Tables, query, rounded



def _num(x: float) -> str:
    return f"{x!r}e0"


def bucket_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} < 1e-6 THEN 0 ELSE CAST(least(999, floor({_num(hist.OFFSET)} + "
        f"ln({v}) / {_num(math.log(hist.BASE))})) AS INTEGER) END"
    )


VALUE_SQL = "CASE WHEN bucket = 0 THEN 0 ELSE pow(1.05e0, bucket - 1) * 1e-6 END"


def stats_sql(source: str, key: str) -> str:
    """CTE list ending in ``stats(key, cnt, sum, min, max, pct_95, median, stddev, cutoff)``."""
    return f"""
    h AS (SELECT {key}, {bucket_sql('v')} AS bucket, count(*) AS n FROM {source} GROUP BY 1, 2),
    x AS (SELECT {key}, count(*) AS cnt, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY 1),
    w AS (SELECT {key}, bucket, n, {VALUE_SQL} AS val,
            sum(n) OVER (PARTITION BY {key}) AS total,
            sum(n) OVER (PARTITION BY {key} ORDER BY bucket DESC) AS seen,
            lag({VALUE_SQL}) OVER (PARTITION BY {key} ORDER BY bucket DESC) AS above FROM h),
    c AS (SELECT *, CASE WHEN total >= 10 THEN floor(total * 0.95e0) ELSE total END AS cut FROM w),
    a AS (SELECT {key}, max(cut) AS cut,
            max(CASE WHEN seen > total - cut THEN val END) AS p,
            arg_max(CASE WHEN cut % 2 = 1 OR n > 1 THEN val
                         ELSE (val + coalesce(above, pow(1.05e0, 998) * 1e-6)) / 2 END,
                    CASE WHEN total - seen <= floor(total / 2) THEN bucket END) AS m,
            sum(n * val) / max(total) AS mean, sum(n * val * val) / max(total) AS sq
          FROM c GROUP BY 1),
    stats AS (SELECT x.{key}, cnt, s, lo, hi,
            CASE WHEN cnt <= 2 OR lo = hi THEN hi ELSE p END AS pct_95,
            CASE WHEN cnt = 1 OR lo = hi THEN hi WHEN cnt = 2 THEN (lo + hi) / 2 ELSE m END AS median,
            CASE WHEN cnt = 1 OR lo = hi THEN 0
                 WHEN cnt = 2 THEN sqrt(2 * pow(hi - (lo + hi) / 2, 2))
                 ELSE least(sqrt(greatest(sq - mean * mean, 0)), (hi - lo) / 2) END AS stddev,
            CASE WHEN cnt <= 2 OR lo = hi THEN cnt ELSE cut END AS cutoff
          FROM x JOIN a ON x.{key} = a.{key})"""


EVENTS_V = "e AS (SELECT event_type, value AS v FROM events)"


@query("class_digest", """
SELECT event_type, count(value) AS cnt, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max
FROM events GROUP BY event_type""")
def class_digest(t: Tables):
    out = dg.digest(t.events, ["event_type"], numeric=["value"])
    return rounded(out.select("event_type", "cnt", "sum", "min", "max"), 4, "sum")


@query("attribute_digest", """
WITH b AS (SELECT event_type, 'value' AS attribute, 'num' AS type, count(value) AS cnt, round(sum(value), 4) AS sum,
  min(value) AS min, max(value) AS max, NULL AS text_min, NULL AS text_max FROM events GROUP BY 1
UNION ALL SELECT event_type, 'slow', 'bool', count(*), sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END),
  min(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), max(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), NULL, NULL FROM events GROUP BY 1
UNION ALL SELECT event_type, 'props', 'string', count(props), NULL, NULL, NULL, min(props), max(props) FROM events GROUP BY 1)
SELECT event_type, attribute, type, cnt, CAST(sum AS DOUBLE) AS sum, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max,
  text_min, text_max FROM b""")
def attribute_digest(t: Tables):
    e = t.events.withColumn("slow", F.when(F.col("value") > 50, "Yes").otherwise("No"))
    return rounded(dg.digest(e, ["event_type"], ["value"], ["props"], ["slow"]), 4, "sum")


@query("global_digest", """
SELECT 'value' AS attribute, count(value) AS cnt, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events
UNION ALL SELECT 'user_id', count(user_id), CAST(sum(user_id) AS DOUBLE), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM events""")
def global_digest(t: Tables):
    classes = dg.digest(t.events, ["event_type"], numeric=["value", "user_id"])
    return rounded(dg.globals_of(classes).select("attribute", "cnt", "sum", "min", "max"), 4, "sum")


@query("attribute_types", """
SELECT 'value' AS attribute, 'num' AS type UNION ALL SELECT 'event_type', 'string'
UNION ALL SELECT 'user_id', 'num' UNION ALL
SELECT 'slow', CASE WHEN bool_and(CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END IN ('Yes', 'No')) THEN 'bool' END FROM events""")
def attribute_types(t: Tables):
    e = t.events.withColumn("slow", F.when(F.col("value") > 50, "Yes").otherwise("No"))
    return dg.infer_types(e, ["value", "event_type", "user_id", "slow"])


@query("log_histogram", f"""
WITH {EVENTS_V} SELECT event_type, {bucket_sql('v')} AS bucket, count(*) AS n FROM e GROUP BY 1, 2""")
def log_histogram(t: Tables):
    return hist.histogram(t.events, ["event_type"], ["value"]).drop("attribute")


@query("histogram_statistics", f"""
WITH {EVENTS_V}, {stats_sql('e', 'event_type')}
SELECT event_type, round(pct_95, 6) AS pct_95, round(median, 6) AS median, round(stddev, 5) AS stddev,
  CAST(cutoff AS BIGINT) AS cutoff FROM stats""")
def histogram_statistics(t: Tables):
    h = hist.histogram(t.events, ["event_type"], ["value"]).drop("attribute")
    x = dg.digest(t.events, ["event_type"], numeric=["value"]).select("event_type", "cnt", "min", "max")
    out = hist.statistics(h, x, ["event_type"]).withColumn("cutoff", F.col("cutoff").cast("long"))
    return rounded(rounded(out, 6, "pct_95", "median"), 5, "stddev")


@query("small_class_statistics", f"""
WITH e AS (SELECT user_id * 100000 + epoch(date_trunc('hour', ts)) // 3600 % 100000 AS k, value AS v FROM events),
{stats_sql('e', 'k')}
SELECT k, cnt, round(pct_95, 6) AS pct_95, round(median, 6) AS median, round(stddev, 5) AS stddev FROM stats""")
def small_class_statistics(t: Tables):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    e = t.events.select((F.col("user_id") * 100000 + hour % 100000).alias("k"), "value")
    out = dg.class_statistics(e, ["k"], ["value"]).select("k", "cnt", "pct_95", "median", "stddev")
    return rounded(rounded(out, 6, "pct_95", "median"), 5, "stddev")


@query("class_metrics", f"""
WITH {EVENTS_V}, {stats_sql('e', 'event_type')}
SELECT event_type, cnt, round(cnt / (SELECT count(*) FROM events), 8) AS pct, round(s, 4) AS sum, lo AS min, hi AS max,
  round(s / cnt, 6) AS avg, round(median, 6) AS median, round(pct_95, 6) AS pct_95, round(stddev, 5) AS stddev FROM stats""")
def class_metrics(t: Tables):
    out = dg.metrics(t.events, ["event_type"], ["value"]).drop("attribute", "cutoff")
    out = rounded(rounded(out, 8, "pct"), 4, "sum")
    return rounded(rounded(out, 6, "avg", "median", "pct_95"), 5, "stddev")


@query("value_counts", """
SELECT event_type, props AS value, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2""")
def value_counts(t: Tables):
    return dg.value_counts(t.events, ["event_type"], ["props"]).drop("attribute")


@query("top_values_text", """
WITH c AS (SELECT event_type, props AS value, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN length(value) > 10 THEN substr(value, 1, 10) || '...' ELSE value END AS ps,
   row_number() OVER (PARTITION BY event_type ORDER BY n DESC, value) AS r,
   count(*) OVER (PARTITION BY event_type) AS uniq FROM c),
i AS (SELECT *, ps || ' (' || n || '), ' AS item FROM p),
q AS (SELECT *, coalesce(sum(length(item)) OVER (PARTITION BY event_type ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
o AS (SELECT *, max(CASE WHEN before + length(ps) > 47 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY r) AS stopped FROM q),
s AS (SELECT event_type, max(uniq) AS uniq, rtrim(string_agg(CASE WHEN stopped = 0 THEN item ELSE '' END, '' ORDER BY r), ', ') AS line,
   sum(CASE WHEN stopped = 0 THEN 1 ELSE 0 END) AS shown FROM o GROUP BY 1)
SELECT event_type, uniq, CASE WHEN shown < uniq THEN line || '... ' || CAST(uniq - shown AS BIGINT) || ' more' ELSE line END AS top FROM s""")
def top_values_text(t: Tables):
    counts = dg.value_counts(t.events, ["event_type"], ["props"])
    return dg.top_values_text(counts, ["event_type"])


@query("digest_by_array", """
WITH e AS (SELECT unnest([event_type, 'user' || CAST(user_id % 10 AS VARCHAR)]) AS tbl, value FROM events)
SELECT tbl, count(*) AS cnt, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM e GROUP BY 1""")
def digest_by_array(t: Tables):
    e = t.events.withColumn(
        "tables", F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")))
    )
    out = dg.digest(dg.unroll(e, "tables", "tbl"), ["tbl"], numeric=["value"])
    return rounded(out.select("tbl", "cnt", "sum", "min", "max"), 4, "sum")


@query("digest_groupings", """
SELECT 'event_type' AS grouping, event_type AS class, count(value) AS cnt, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY event_type
UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(value), round(sum(value), 4), min(value), max(value) FROM events GROUP BY user_id""")
def digest_groupings(t: Tables):
    return rounded(dg.digest_groupings(t.events, ["event_type", "user_id"], "value"), 4, "sum")


@query("worst_samples", """
SELECT event_type, arg_max(event_id, (value, event_id)) AS event_id, arg_max(value, (value, event_id)) AS value,
  arg_max(props, (value, event_id)) AS props FROM events GROUP BY 1""")
def worst_samples(t: Tables):
    return dg.worst_samples(t.events, ["event_type"], "value", ["event_id", "value", "props"], "event_id")


RATES_SQL = """count(*) AS cnt, round(sum(value), 4) AS sum, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM events"""


@query("class_rates", f"""
WITH r AS (SELECT event_type, {RATES_SQL} GROUP BY 1)
SELECT event_type, cnt, sum, round(secs, 6) AS seconds, CASE WHEN secs > 0 THEN round(cnt / secs, 9) ELSE 0 END AS qps,
  CASE WHEN secs > 0 THEN round(sum / secs, 9) ELSE 0 END AS concurrency FROM r""")
def class_rates(t: Tables):
    out = rounded(dg.rates(t.events, ["event_type"], "value", "ts"), 4, "sum")
    return rounded(rounded(out, 9, "qps", "concurrency"), 6, "seconds")


@query("global_rates", f"""
WITH r AS (SELECT {RATES_SQL})
SELECT cnt, sum, round(secs, 6) AS seconds, CASE WHEN secs > 0 THEN round(cnt / secs, 9) ELSE 0 END AS qps,
  CASE WHEN secs > 0 THEN round(sum / secs, 9) ELSE 0 END AS concurrency FROM r""")
def global_rates(t: Tables):
    out = rounded(dg.rates(t.events, [], "value", "ts"), 4, "sum")
    return rounded(rounded(out, 9, "qps", "concurrency"), 6, "seconds")


@query("distribution_bars", f"""
WITH {EVENTS_V}, h AS (SELECT event_type, {bucket_sql('v')} AS bucket, count(*) AS n FROM e GROUP BY 1, 2),
d AS (SELECT event_type, {' + '.join(f'(CASE WHEN bucket >= {s} THEN 1 ELSE 0 END)' for s in hist.decade_starts())} AS decade,
  CAST(sum(n) AS BIGINT) AS n FROM h WHERE bucket > 0 GROUP BY 1, 2)
SELECT event_type, decade, ['1us','10us','100us','1ms','10ms','100ms','1s','10s+'][decade + 1] AS label, n,
  repeat('#', CAST(greatest(1, floor(n / (max(n) OVER (PARTITION BY event_type) / 64e0))) AS INTEGER)) AS bar FROM d""")
def distribution_bars(t: Tables):
    h = hist.histogram(t.events, ["event_type"], ["value"]).drop("attribute")
    return hist.distribution_bars(h, ["event_type"])


@query("trimmed_statistics", """
WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, count(*) AS cnt, round(sum(v), 2) AS sum, round(avg(v), 4) AS avg, min(v) AS min, max(v) AS max
FROM r WHERE r <= floor(n * 95 / 100) GROUP BY 1""")
def trimmed_statistics(t: Tables):
    out = dg.trimmed_statistics(t.lineitem, ["l_returnflag"], "l_extendedprice", 95)
    return rounded(rounded(out, 2, "sum"), 4, "avg")


@query("value_distribution", """
WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, n * 100e0 / sum(n) OVER (PARTITION BY l_returnflag) AS pct FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS line FROM p WHERE pct >= 1.9)
SELECT l_returnflag, l_quantity, n, round(pct, 6) AS pct, line FROM r WHERE line <= 10""")
def value_distribution(t: Tables):
    return rounded(dg.value_distribution(t.lineitem, ["l_returnflag"], "l_quantity", 1.9, 10), 6, "pct")


@query("class_summary", """
SELECT event_type, count(*) AS c, min(value) AS value_min, max(value) AS value_max, round(sum(value), 4) AS value_sum,
  round(avg(value), 6) AS value_avg, arg_min(user_id, event_id) AS first_user_id, arg_min(props, event_id) AS first_props
FROM events GROUP BY 1""")
def class_summary(t: Tables):
    out = dg.class_summary(t.events, ["event_type"], ["value"], ["user_id", "props"], "event_id")
    return rounded(rounded(out, 4, "value_sum"), 6, "value_avg")


@query("class_user_share", """
SELECT event_type, user_id, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY event_type), 6) AS pct
FROM events GROUP BY 1, 2""")
def class_user_share(t: Tables):
    return rounded(dg.value_share(t.events, ["event_type"], "user_id"), 6, "pct")


@query("grouped_counts", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def grouped_counts(t: Tables):
    return dg.grouped_counts(t.orders, "o_orderstatus", "o_orderpriority")


@query("sample_moments", """
SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 5) AS variance,
  round(stddev_samp(l_quantity), 6) AS stddev FROM lineitem GROUP BY 1""")
def sample_moments(t: Tables):
    out = dg.sample_moments(t.lineitem, ["l_suppkey"], "l_quantity")
    return rounded(rounded(out, 6, "mean", "stddev"), 5, "variance")


@query("event_timeline", """
WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st FROM events),
g AS (SELECT *, sum(st) OVER (ORDER BY event_id) AS grp FROM l)
SELECT any_value(event_type) AS event_type, min(event_id) AS start_event_id, count(*) AS cnt, round(sum(value), 4) AS sum,
  min(value) AS min, max(value) AS max, min(ts) AS ts_min, max(ts) AS ts_max, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds
FROM g GROUP BY grp""")
def event_timeline(t: Tables):
    out = dg.timeline(t.events, ["event_type"], "value", "ts", ["event_id"], ordered.id_block("event_id"))
    return rounded(rounded(out, 4, "sum"), 6, "seconds")


@query("user_timeline", """
WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st FROM events),
g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM l)
SELECT user_id, any_value(event_type) AS event_type, min(event_id) AS start_event_id, count(*) AS cnt, round(sum(value), 4) AS total
FROM g GROUP BY user_id, grp""")
def user_timeline(t: Tables):
    out = ordered.runs(
        t.events, ["event_type"], ["event_id"], ordered.id_block("event_id"), ["user_id"],
        {"cnt": ("count", "value"), "total": ("sum", "value")},
    )
    return rounded(out, 4, "total")


USERS_STATS = f"WITH e AS (SELECT user_id, value AS v FROM events), {stats_sql('e', 'user_id')}"


def _user_classes(t: Tables):
    """The class table of a report: written once, then read by each of its parts."""
    classes = dg.class_statistics(t.events, ["user_id"], ["value"]).withColumn("sum", F.round("sum", 4))
    return lineage.written(classes.select("user_id", "cnt", "sum", "pct_95"), "classes")


@query("top_classes", f"""
{USERS_STATS},
k AS (SELECT user_id, cnt, round(s, 4) AS sum, pct_95 FROM stats),
r AS (SELECT *, coalesce(sum(sum) OVER (ORDER BY sum DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (ORDER BY sum DESC, user_id) AS rn FROM k)
SELECT user_id, cnt, sum, round(pct_95, 6) AS pct_95,
  CASE WHEN before < 0.95 * (SELECT sum(sum) FROM k) AND rn <= 20 THEN 'top' ELSE 'outlier' END AS reason
FROM r WHERE (before < 0.95 * (SELECT sum(sum) FROM k) AND rn <= 20) OR (cnt >= 10 AND pct_95 >= 170)""")
def top_classes(t: Tables):
    classes = _user_classes(t)
    limit = classes.agg(F.sum("sum") * 0.95).scalar()
    chosen = dg.top_classes(
        classes, "sum", "user_id", count_limit=20, pct_of=limit,
        outlier=dg.outlier_test("cnt", "pct_95", 10, 170.0),
    )
    return rounded(chosen, 6, "pct_95")


@query("top_classes_by_share", """
WITH k AS (SELECT user_id, count(*) AS cnt, round(sum(value), 4) AS sum FROM events GROUP BY 1),
r AS (SELECT *, coalesce(sum(sum) OVER (ORDER BY sum DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT user_id, cnt, sum, 'top' AS reason FROM r WHERE before < 0.5 * (SELECT sum(sum) FROM k)""")
def top_classes_by_share(t: Tables):
    classes = _user_classes(t).drop("pct_95")
    limit = classes.agg(F.sum("sum") * 0.5).scalar()
    return dg.top_classes(classes, "sum", "user_id", pct_of=limit)


@query("top_classes_equal_metric", """
WITH k AS (SELECT 'class ' || o_custkey AS class, CAST(count(*) AS DOUBLE) AS orders, CASE WHEN o_custkey % 50 = 0 THEN 9.5 ELSE 2.5 END AS metric FROM orders GROUP BY o_custkey),
r AS (SELECT *, coalesce(sum(metric) OVER (ORDER BY metric DESC, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT class, orders, metric, 'top' AS reason FROM r WHERE before < 0.5 * (SELECT sum(metric) FROM k)""")
def top_classes_equal_metric(t: Tables):
    """Nearly all classes have one metric, so the cut falls among equal ones: their ids are counted, and few are sorted."""
    k = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"))
    classes = lineage.written(k.select(F.concat(F.lit("class "), "o_custkey").alias("class"), "orders", F.when(F.col("o_custkey") % 50 == 0, 9.5).otherwise(2.5).alias("metric")), "classes")
    return dg.top_classes(classes, "metric", "class", pct_of=classes.agg(F.sum("metric") * 0.5).scalar(), block=100)


@query("trimmed_epoch_values", """
WITH r AS (SELECT event_type, floor(epoch(ts)) AS v, row_number() OVER (PARTITION BY event_type ORDER BY floor(epoch(ts))) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS cnt, sum(v) AS sum, round(avg(v), 3) AS avg, min(v) AS min, max(v) AS max FROM r WHERE r <= floor(n * 95 / 100) GROUP BY 1""")
def trimmed_epoch_values(t: Tables):
    """Times as numbers: they differ in their last digits only, so one power of two holds them all."""
    e = t.events.select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("v"))
    return rounded(dg.trimmed_statistics(e, ["event_type"], "v", 95, block=100), 3, "avg")


@query("response_profile", """
WITH k AS (SELECT user_id, count(*) AS calls, round(sum(value), 4) AS time FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY time DESC, user_id) AS rank FROM k)
SELECT rank, user_id, time, round(time / sum(time) OVER () * 100, 6) AS pct_reported, calls, round(time / calls, 6) AS per_call
FROM r WHERE rank <= 10""")
def response_profile(t: Tables):
    k = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("time"))
    top = dg.top_classes(k, "time", "user_id", count_limit=10).drop("reason")
    out = dg.ranked_report(top, "time", "user_id").withColumn("per_call", F.col("time") / F.col("calls"))
    return rounded(out, 6, "pct_reported", "per_call")


@query("sort_fallback", """
SELECT event_type, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1""")
def sort_fallback(t: Tables):
    """Classes ordered by an attribute that the data lacks: the count is taken instead."""
    classes = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    by = dg.order_attribute(classes.columns, "Lock_time")
    return dg.ranked_report(classes, by, "event_type").select("event_type", "cnt", "rank")
