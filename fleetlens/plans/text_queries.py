"""Statement normalisation, dates and numbers over derived statements and whole texts.

``STATEMENT`` turns each ``lineitem`` row into a statement of one of ten shapes;
the oracles state the expected result per shape, so they share no pattern with
the functions under test. ``documents.text`` and ``pages.url`` run through the
same rewrites in DuckDB's own regular expressions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import dates, numbers, privileges, text
from fleetlens.operators import digest as dg
from fleetlens.plans.registry import Tables, query, rounded, when_ts

K = "CAST(l_orderkey AS STRING)"
STATEMENT = f"""CASE
 WHEN l_linenumber = 1 THEN 'SELECT `l_quantity` FROM lineitem AS l JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey = ' || {K} || ' AND note = "it ' || {K} || '" LIMIT 5, 10'
 WHEN l_linenumber = 2 THEN 'INSERT INTO db' || CAST(l_orderkey % 10 AS STRING) || '.t' || CAST(l_orderkey % 3 AS STRING) || ' (a, b) VALUES (' || {K} || ', 1.5), (2, 3.5e7)'
 WHEN l_linenumber = 3 THEN 'UPDATE part_' || {K} || ' SET x = 0xAF WHERE id IN (' || {K} || ', 2, 3) AND s IN ("a", "b")'
 WHEN l_linenumber = 4 THEN 'DELETE FROM events WHERE a = -5 AND b IS NULL -- gone ' || {K}
 WHEN l_linenumber = 5 THEN '/* app */ SELECT a FROM t1 WHERE b = ' || {K} || ' UNION ALL SELECT a FROM t1 WHERE b = 7'
 WHEN l_linenumber = 6 THEN 'CREATE TABLE IF NOT EXISTS `tmp' || {K} || '` AS SELECT * FROM big, small'
 WHEN l_orderkey % 4 = 0 THEN 'call proc_' || {K} || '(1, 2)'
 WHEN l_orderkey % 4 = 1 THEN '# administrator command: Quit'
 WHEN l_orderkey % 4 = 2 THEN 'use db' || {K}
 ELSE 'SHOW TABLE STATUS FROM sch' || {K} END"""

ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SHAPES = ["l_linenumber = 1", "l_linenumber = 2", "l_linenumber = 3", "l_linenumber = 4", "l_linenumber = 5",
          "l_linenumber = 6", "l_linenumber >= 7 AND l_orderkey % 4 = 0", "l_linenumber >= 7 AND l_orderkey % 4 = 1",
          "l_linenumber >= 7 AND l_orderkey % 4 = 2", "l_linenumber >= 7 AND l_orderkey % 4 = 3"]


def statements(t: Tables):
    return t.lineitem.select(*ID.split(", "), F.expr(STATEMENT).alias("sql"))


def per_shape(name: str, *expected: str) -> str:
    """Oracle: the expected value of each of the ten shapes."""
    cases = " ".join(f"WHEN {s} THEN {e}" for s, e in zip(SHAPES, expected))
    return f"SELECT {ID}, CASE {cases} END AS {name} FROM lineitem"


@query("fingerprint", per_shape(
    "fingerprint",
    "'select `l_quantity` from lineitem as l join orders on o_orderkey = l_orderkey where l_orderkey = ? and note = ? limit ?'",
    "'insert into d?t? (a, b) values(?+)'",
    "'update part_? set x = ?af where id in(?+) and s in(?+)'",
    "'delete from events where a = ? and b is ? '",
    "'select a from t? where b = ? /*repeat union all*/'",
    "'create table if not exists `tmp?` as select * from big, small'",
    f"'call proc_' || {K}", "'# administrator command: Quit'", "'use ?'", "'show table status from sch?'"))
def fingerprint(t: Tables):
    return statements(t).withColumn("fingerprint", text.fingerprint("sql")).drop("sql")


@query("abstract_statement", per_shape(
    "abstract",
    "'select `l_quantity` from lineitem as l join orders on o_orderkey = l_orderkey where l_orderkey = N and note = \"S\" limit N, N'",
    "'insert into db' || l_orderkey % 10 || '.t' || l_orderkey % 3 || ' (a, b) values (N, N.N), (N, N.5e7)'",
    f"'update part_' || {K} || ' set x = N where id IN (N3) and s IN (S2)'",
    "'delete from events where a = -N and b is null -- gone N'",
    "'/* app */ select a from t1 where b = N union all select a from t1 where b = N'",
    f"'create table if not exists `tmp' || {K} || '` as select * from big, small'",
    f"'call proc_' || {K} || '(N, N)'", "'# administrator command: quit'", f"'use db' || {K}",
    f"'show table status from sch' || {K}"))
def abstract_statement(t: Tables):
    return statements(t).withColumn("abstract", text.abstract_stmt("sql")).drop("sql")


@query("distill", per_shape(
    "distilled", "'SELECT lineitem orders'", "'INSERT db?.t?'", "'UPDATE part_?'", "'DELETE events'", "'SELECT UNION t?'",
    "'CREATE TABLE big small IF'", f"'CALL proc_' || {K}", "'ADMIN'", "'USE'", "'SHOW TABLE STATUS sch?'"))
def distill(t: Tables):
    return statements(t).withColumn("distilled", text.distill("sql")).drop("sql")


@query("distill_verbs", per_shape(
    "verbs", "'SELECT'", "'INSERT'", "'UPDATE'", "'DELETE'", "'SELECT UNION'", "'CREATE TABLE'",
    f"'CALL proc_' || {K}", "'ADMIN'", "'USE'", "'SHOW TABLE STATUS'"))
def distill_verbs(t: Tables):
    return statements(t).withColumn("verbs", text.distill_verbs("sql")).drop("sql")


@query("statement_tables", per_shape(
    "tables", "'lineitem,orders'", "'db' || l_orderkey % 10 || '.t' || l_orderkey % 3", f"'part_' || {K}", "'events'",
    "'t1,t1'", "'big,small'", "''", "''", "''", f"'sch' || {K}"))
def statement_tables(t: Tables):
    return statements(t).withColumn("tables", F.array_join(text.get_tables("sql"), ",")).drop("sql")


@query("statement_type", per_shape(
    "rw", "'read'", "'write'", "'write'", "'write'", "'read'", "'write'", "NULL", "NULL", "NULL", "NULL"))
def statement_type(t: Tables):
    return statements(t).withColumn("rw", text.query_type("sql")).drop("sql")


@query("split_statements", per_shape(
    "parts",
    f"'SELECT `l_quantity` FROM lineitem AS l JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey = ' || {K} || ' AND note = \"it ' || {K} || '\" LIMIT 5, 10'",
    f"'INSERT INTO db' || l_orderkey % 10 || '.t' || l_orderkey % 3 || ' (a, b) VALUES (' || {K} || ', 1.5), (2, 3.5e7)'",
    f"'UPDATE part_' || {K} || ' SET x = 0xAF WHERE id IN (' || {K} || ', 2, 3) AND s IN (\"a\", \"b\")'",
    f"'DELETE FROM events WHERE a = -5 AND b IS NULL -- gone ' || {K}",
    f"'SELECT a FROM t1 WHERE b = ' || {K} || ' |UNION ALL |SELECT a FROM t1 WHERE b = 7'",
    f"'CREATE TABLE IF NOT EXISTS `tmp' || {K} || '` AS |SELECT * FROM big, small'",
    f"'call proc_' || {K} || '(1, 2)'", "'# administrator command: Quit'", f"'use db' || {K}",
    f"'SHOW TABLE STATUS FROM sch' || {K}"))
def split_statements(t: Tables):
    return statements(t).withColumn("parts", F.array_join(text.split_statements("sql"), "|")).drop("sql")


@query("shorten_statement", """
WITH b AS (SELECT o_orderkey // 30 AS grp, string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS ids,
  string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) FILTER (rn <= 20) AS kept, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 30 ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1)
SELECT grp, 'SELECT * FROM orders WHERE id IN (' || CASE WHEN n > 20 AND length(ids) + 34 > 60
  THEN kept || '/*... omitted ' || (n - 20) || ' items ...*/' ELSE ids END || ')' AS short FROM b""")
def shorten_statement(t: Tables):
    # Lists of at most thirty keys, by key range.
    ids = F.array_join(
        F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ", "
    )
    q = t.orders.groupBy(F.floor(F.col("o_orderkey") / 30).alias("grp")).agg(
        F.concat(F.lit("SELECT * FROM orders WHERE id IN ("), ids, F.lit(")")).alias("sql")
    )
    return q.select("grp", text.shorten("sql", 60).alias("short"))


@query("shorten_insert", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'INSERT INTO t VALUES (' || l_partkey || ', 1) /*... omitted ...*/' ||
  CASE WHEN l_linenumber % 2 = 0 THEN 'ON DUPLICATE KEY UPDATE a = 1' ELSE '' END AS short FROM lineitem""")
def shorten_insert(t: Tables):
    sql = F.concat(
        F.lit("INSERT INTO t VALUES ("), F.col("l_partkey").cast("string"), F.lit(", 1), (2, 3), (4, 5) "),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("ON DUPLICATE KEY UPDATE a = 1")).otherwise(F.lit("")),
    )
    return t.lineitem.select(*ID.split(", "), text.shorten(sql, 0).alias("short"))


FP_STEPS = [
    (r"(?:--|#)[^''\"\r\n]*([\r\n]|\z)", r"\1"), (r"(?s)/\*[^!].*?\*/", ""), (r"\\[\"'']", ""), (r'(?s)".*?"', "?"),
    (r"(?s)''.*?''", "?"), (r"[0-9+-][0-9a-f.xb+-]*", "?"), (r"[xb.+-]\?", "?"), (r"\A\s+", ""), (r"\n\z", ""),
    (r"[ \n\t\r\f]+", " "),
]


def fp_sql(col: str) -> str:
    """The rewrites of a fingerprint in DuckDB, without the UNION rule (no back-references there)."""
    for pattern, repl in FP_STEPS:
        col = f"regexp_replace({col}, '{pattern}', '{repl}', 'g')"
    col = f"regexp_replace(lower({col}), '\\bnull\\b', '?', 'g')"
    col = f"regexp_replace({col}, '\\b(in|values?)(?:[\\s,]*\\([\\s?,]*\\))+', '\\1(?+)', 'g')"
    return f"regexp_replace({col}, '\\blimit \\?(?:, ?\\?| offset \\?)?', 'limit ?')"


@query("document_classes", f"""
WITH f AS (SELECT doc_id, {fp_sql('text')} AS fp FROM documents)
SELECT doc_id, length(fp) AS fp_length, upper(right(md5(fp), 16)) AS class_id FROM f""")
def document_classes(t: Tables):
    d = t.documents.select("doc_id", text.fingerprint("text").alias("fp"))
    return d.select("doc_id", F.length("fp").cast("long").alias("fp_length"), text.class_id("fp").alias("class_id"))


@query("document_class_counts", f"""
SELECT upper(right(md5({fp_sql('text')}), 16)) AS class_id, count(*) AS cnt, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def document_class_counts(t: Tables):
    key = lambda raw: text.class_id(text.fingerprint(raw))
    return dg.rewritten_classes(t.documents, "text", key, "class_id", sums={"chars": "n_chars"}).select("class_id", "cnt", "chars")


@query("conversation_classes", f"""
SELECT upper(right(md5({fp_sql('text')}), 16)) AS class_id, role, count(*) AS cnt FROM conversations GROUP BY 1, 2""")
def conversation_classes(t: Tables):
    key = lambda raw: text.class_id(text.fingerprint(raw))
    return dg.rewritten_classes(t.conversations, "text", key, "class_id", ["role"])


@query("strip_comments", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?:--|#)[^''"\r\n]*([\r\n]|\z)', '\1', 'g'), '(?s)/\*[^!].*?\*/', '', 'g')) AS h FROM documents""")
def strip_comments(t: Tables):
    return t.documents.select("doc_id", F.md5(text.strip_comments("text")).alias("h"))


@query("clean_query", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/\*.*?\*/', ' ', 'g'), '\A[\s\v]+', '', 'g'), '[\s\v]+\z', '', 'g'), '[\s\v]{2,}', ' ', 'g')) AS h FROM documents""")
def clean_query(t: Tables):
    return t.documents.select("doc_id", F.md5(text.clean_query("text")).alias("h"))


@query("derived_tables", r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 3 = 0 AS derived FROM lineitem""")
def derived_tables(t: Tables):
    sql = F.when(F.col("l_linenumber") % 3 == 0, F.lit("SELECT * FROM ( SELECT 1 ) x")).otherwise(F.lit("SELECT (SELECT 1) FROM t"))
    return t.lineitem.select(*ID.split(", "), text.has_derived_table(sql).alias("derived"))


@query("request_classes", r"""
SELECT page_id, 'GET ' || regexp_replace(url, '\?.*', '') AS request FROM pages""")
def request_classes(t: Tables):
    req = text.distill_generic(F.concat(F.lit("get "), F.col("url")), trim_url=True)
    return t.pages.select("page_id", req.alias("request"))


@query("key_fingerprint", r"""
SELECT page_id, regexp_replace(url, '[0-9A-Fa-f]{16,}|[0-9]+', '?', 'g') AS key FROM pages""")
def key_fingerprint(t: Tables):
    return t.pages.select("page_id", text.key_fingerprint("url").alias("key"))


@query("key_value_flags", """
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'set' WHEN 2 THEN 'delete' ELSE 'gets' END AS cmd,
  CASE event_id % 5 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'INTERRUPTED' WHEN 2 THEN 'NOT_STORED' WHEN 3 THEN 'EXISTS' END AS res FROM events)
SELECT event_id, CASE WHEN cmd = 'get' THEN 'Yes' ELSE 'No' END AS is_get, CASE WHEN res = 'NOT_FOUND' THEN 'Yes' ELSE 'No' END AS miss,
  CASE WHEN cmd IN ('get', 'gets') AND res = 'INTERRUPTED' THEN 'Yes' ELSE 'No' END AS error,
  CASE WHEN cmd = 'set' AND res IS NOT NULL THEN CASE WHEN res = 'NOT_STORED' THEN 'Yes' ELSE 'No' END END AS not_stored,
  CASE WHEN cmd = 'set' AND res IS NOT NULL THEN CASE WHEN res = 'EXISTS' THEN 'Yes' ELSE 'No' END END AS exists_already FROM e""")
def key_value_flags(t: Tables):
    e = t.events.select(
        "event_id",
        F.expr("CASE event_id % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'set' WHEN 2 THEN 'delete' ELSE 'gets' END").alias("cmd"),
        F.expr("CASE event_id % 5 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'INTERRUPTED' WHEN 2 THEN 'NOT_STORED' WHEN 3 THEN 'EXISTS' END").alias("res"),
    )
    flags = text.key_value_flags("cmd", "res")
    return e.select(
        "event_id", flags["Memc_get"].alias("is_get"), flags["Memc_miss"].alias("miss"), flags["Memc_error"].alias("error"),
        flags["Memc_Not_Stored"].alias("not_stored"), flags["Memc_Exists"].alias("exists_already"),
    )


@query("class_checksum", """
SELECT c_custkey, upper(right(md5(c_name), 16)) AS class_id, CAST(('0x' || right(md5(c_name), 16)) AS UBIGINT)::VARCHAR AS checksum FROM customer""")
def class_checksum(t: Tables):
    return t.customer.select(
        "c_custkey", text.class_id("c_name").alias("class_id"), text.class_checksum("c_name").cast("string").alias("checksum")
    )


@query("strip_auto_increment", """
SELECT o_orderkey, 'CREATE TABLE t' || o_custkey || ' (a int) ENGINE=InnoDB DEFAULT CHARSET=utf8' AS ddl FROM orders""")
def strip_auto_increment(t: Tables):
    ddl = F.concat(
        F.lit("CREATE TABLE t"), F.col("o_custkey").cast("string"), F.lit(" (a int) ENGINE=InnoDB AUTO_INCREMENT="),
        F.col("o_orderkey").cast("string"), F.lit(" DEFAULT CHARSET=utf8"),
    )
    return t.orders.select("o_orderkey", text.strip_auto_increment(ddl).alias("ddl"))


@query("embedded_attributes", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS user_id, o_orderstatus AS page FROM orders""")
def embedded_attributes(t: Tables):
    sql = F.concat(
        F.lit("SELECT 1 /* file: a, user: "), F.col("o_custkey").cast("string"), F.lit(", page: "), F.col("o_orderstatus"), F.lit(" */")
    )
    found = text.embedded_attributes(sql, r"/\*.*?\*/", r"(\w+): (\w+)")
    return t.orders.select("o_orderkey", found["user"].alias("user_id"), found["page"].alias("page"))


# --- dates ---------------------------------------------------------------------------


@query("short_timestamps", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS secs FROM events""")
def short_timestamps(t: Tables):
    short = F.date_format("ts", "yyMMdd  H:mm:ss")
    return t.events.select(
        "event_id", dates.parse_timestamp(short).alias("parsed"),
        dates.unix_timestamp(dates.parse_timestamp(short)).alias("secs"),
    )


@query("fractional_timestamps", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS parsed, round(epoch_us(ts) / 1e6, 6) AS secs FROM events""")
def fractional_timestamps(t: Tables):
    short = F.date_format("ts", "yyMMdd HH:mm:ss.SSSSSS")
    parsed = dates.parse_timestamp(short)
    return t.events.select("event_id", parsed.alias("parsed"), F.round(dates.unix_timestamp(parsed), 6).alias("secs"))


@query("any_timestamps", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(TIMESTAMP '2024-01-01') - (o_orderkey % 1000) * 60
  WHEN 1 THEN epoch(TIMESTAMP '2024-01-01') - (o_orderkey % 1000) * 86400 WHEN 2 THEN epoch(CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate + INTERVAL 100 YEAR ELSE o_orderdate END) ELSE epoch(o_orderdate) END AS secs FROM orders""")
def any_timestamps(t: Tables):
    n = (F.col("o_orderkey") % 1000).cast("string")
    kind = F.col("o_orderkey") % 4
    given = (
        F.when(kind == 0, F.concat(n, F.lit("m"))).when(kind == 1, F.concat(n, F.lit("d")))
        .when(kind == 2, F.date_format("o_orderdate", "yyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    now = F.lit("2024-01-01").cast("timestamp")
    return t.orders.select("o_orderkey", dates.any_unix_timestamp(given, now).alias("secs"))


@query("relative_times", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate - to_hours(CAST(o_orderkey % 50 AS INTEGER)) WHEN 1 THEN o_orderdate - to_days(CAST(o_orderkey % 50 AS INTEGER))
  WHEN 2 THEN o_orderdate - to_days(CAST(7 * (o_orderkey % 50) AS INTEGER)) ELSE o_orderdate - to_months(CAST(o_orderkey % 50 AS INTEGER)) END AS at FROM orders""")
def relative_times(t: Tables):
    unit = F.element_at(F.array(F.lit("h"), F.lit("d"), F.lit("w"), F.lit("m")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    spec = F.concat((F.col("o_orderkey") % 50).cast("string"), unit)
    return t.orders.select("o_orderkey", when_ts(dates.seconds_ago(spec, "o_orderdate")).alias("at"))


@query("secs_to_time", """
WITH s AS (SELECT o_orderkey, (o_orderkey * 37) % 400000 AS s FROM orders)
SELECT o_orderkey, CASE WHEN s = 0 THEN '00:00' WHEN s >= 86400 THEN printf('%d+%02d:%02d:%02d', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60)
  WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s % 3600 // 60, s % 60) END AS clock FROM s""")
def secs_to_time(t: Tables):
    return t.orders.select("o_orderkey", dates.secs_to_time((F.col("o_orderkey") * 37) % 400000).alias("clock"))


@query("timespec_shifts", """
SELECT o_orderkey, date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH AS prev_quarter, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS next_month,
  o_orderdate - INTERVAL 1 YEAR AS year_ago, date_trunc('week', o_orderdate) + INTERVAL 2 WEEK AS two_weeks, o_orderdate + INTERVAL 36 HOUR AS hours FROM orders""")
def timespec_shifts(t: Tables):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", when_ts(dates.timespec("-1q startof", d)).alias("prev_quarter"),
        when_ts(dates.timespec("1m.startof", d)).alias("next_month"), when_ts(dates.timespec("-1y", d)).alias("year_ago"),
        when_ts(dates.timespec("+2w startof", d)).alias("two_weeks"), when_ts(dates.timespec("36h", d)).alias("hours"),
    )


@query("age_from_name", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS born, coalesce(o_orderkey % 5 > 0 AND o_orderdate <= TIMESTAMP '1998-01-01', false) AS old FROM orders""")
def age_from_name(t: Tables):
    name = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "'test_'yyyyMMdd")).otherwise("test_none")
    born = dates.age_from_name(name, "test_%Y%m%d")
    limit = F.lit("1998-01-01").cast("timestamp")
    return t.orders.select("o_orderkey", when_ts(born).alias("born"), F.coalesce(born <= limit, F.lit(False)).alias("old"))


@query("rotated_names", """
SELECT o_orderkey, 'orders_' || strftime(o_orderdate, '%Y%m%d') AS by_day, 'orders_' || strftime(o_orderdate, '%Y') || '_' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS by_week FROM orders""")
def rotated_names(t: Tables):
    return t.orders.select(
        "o_orderkey", dates.rotated_name(F.lit("orders"), "o_orderdate", "_%Y%m%d").alias("by_day"),
        dates.rotated_name(F.lit("orders"), "o_orderdate", "_%Y_%V").alias("by_week"),
    )


@query("retention_cutoffs", """
SELECT o_orderkey, o_orderdate - INTERVAL 30 DAY AS d30, o_orderdate - INTERVAL 28 DAY AS w4, o_orderdate - INTERVAL 6 MONTH AS m6, o_orderdate - INTERVAL 2 YEAR AS y2 FROM orders""")
def retention_cutoffs(t: Tables):
    cut = lambda r: when_ts(dates.retention_cutoff(r, "o_orderdate"))
    return t.orders.select("o_orderkey", cut("30d").alias("d30"), cut("4w").alias("w4"), cut("6m").alias("m6"), cut("2y").alias("y2"))


@query("compound_durations", """
SELECT o_orderkey, (o_orderkey % 3) * 31536000 + (o_orderkey % 12) * 2592000 + (o_orderkey % 4) * 604800 + (o_orderkey % 60) AS secs FROM orders""")
def compound_durations(t: Tables):
    k = F.col("o_orderkey")
    part = lambda n, u: F.concat((k % n).cast("string"), F.lit(u))
    spec = F.concat(part(3, "y"), part(12, "M"), part(4, "w"), part(60, "s"))
    return t.orders.select("o_orderkey", dates.compound_seconds(spec).alias("secs"))


@query("clock_differences", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 86400 - value END AS secs FROM (SELECT event_id, round(value, 2) AS value FROM events)""")
def clock_differences(t: Tables):
    start = F.col("ts").cast("timestamp")
    micros = F.unix_micros(start)
    v = (F.col("value") * 100).cast("decimal(20,0)").cast("long") * 10000
    end = F.timestamp_micros(F.when(F.col("event_id") % 2 == 0, micros + v).otherwise(micros - v))
    return rounded(t.events.select("event_id", dates.clock_difference(start, end).alias("secs")), 2, "secs")


# --- numbers --------------------------------------------------------------------------


@query("human_times", """
WITH v AS (SELECT event_id, event_id % 3 AS kind, CAST(event_id % 999 + 1 AS INTEGER) AS n FROM events)
SELECT event_id, CASE kind WHEN 0 THEN n || 'us' WHEN 1 THEN n || 'ms' ELSE n || 's' END AS t FROM v""")
def human_times(t: Tables):
    n = (F.col("event_id") % 999 + 1).cast("double")
    kind = F.col("event_id") % 3
    secs = F.when(kind == 0, n / 1e6).when(kind == 1, n / 1e3).otherwise(n)
    return t.events.select("event_id", numbers.micro_t(secs).alias("t"))


@query("human_numbers", """
WITH b AS (SELECT o_orderkey, o_orderkey * o_orderkey AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) WHEN n < 1048576 THEN printf('%.2fk', n / 1024) WHEN n < 1073741824 THEN printf('%.2fM', n / 1048576)
  WHEN n < 1099511627776 THEN printf('%.2fG', n / 1073741824) ELSE printf('%.2fT', n / 1099511627776) END AS size FROM b""")
def human_numbers(t: Tables):
    return t.orders.select("o_orderkey", numbers.shorten_number(F.col("o_orderkey") * F.col("o_orderkey")).alias("size"))


@query("percentages", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(floor(l_linenumber * 100 / (l_quantity)) AS BIGINT) AS VARCHAR) AS pct FROM lineitem""")
def percentages(t: Tables):
    return t.lineitem.select(*ID.split(", "), numbers.percentage_of("l_linenumber", "l_quantity").alias("pct"))


@query("nearest_values", """
SELECT o_orderkey, round(o_totalprice / 7, 2) AS cents, round(floor(o_totalprice / 50 + 0.5) * 50, 2) AS fifties FROM orders""")
def nearest_values(t: Tables):
    return t.orders.select(
        "o_orderkey", numbers.nearest_cent(F.col("o_totalprice") / 7).alias("cents"),
        F.round(numbers.nearest(50, "o_totalprice"), 2).alias("fifties"),
    )


@query("wide_counters", """
SELECT o_orderkey, CAST(CAST(o_custkey AS HUGEINT) * 4294967296 + o_orderkey AS VARCHAR) AS joined,
  CAST((CAST(o_custkey AS HUGEINT) * 4294967296 + o_orderkey) * 1000003 AS VARCHAR) AS product, o_orderkey AS from_hex FROM orders""")
def wide_counters(t: Tables):
    joined = numbers.hi_lo("o_custkey", "o_orderkey")
    return t.orders.select(
        "o_orderkey", joined.cast("string").alias("joined"),
        (joined * F.lit(1000003).cast("decimal(10,0)")).cast("decimal(38,0)").cast("string").alias("product"),
        numbers.hi_lo(F.hex("o_orderkey")).cast("long").alias("from_hex"),
    )


@query("port_numbers", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '11211' WHEN 1 THEN '80' WHEN 2 THEN '3306' ELSE CAST(event_id AS VARCHAR) END AS port FROM events""")
def port_numbers(t: Tables):
    name = F.expr("CASE event_id % 4 WHEN 0 THEN 'memcached' WHEN 1 THEN 'http' WHEN 2 THEN 'mysql' ELSE CAST(event_id AS STRING) END")
    return t.events.select("event_id", numbers.port_number(name).alias("port"))


@query("address_numbers", """
SELECT c_custkey, 10::BIGINT * 16777216 + (c_custkey % 256) * 65536 + (c_nationkey) * 256 + 7 AS ip FROM customer""")
def address_numbers(t: Tables):
    ip = F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 256).cast("string"), F.col("c_nationkey").cast("string"), F.lit("7"))
    return t.customer.select("c_custkey", numbers.ip_to_long(ip).alias("ip"))


@query("privilege_sets", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Select_priv,Show_view_priv' WHEN c_custkey % 3 = 1 THEN 'Create_tmp_table_priv' ELSE 'Execute_priv,Insert_priv' END AS flags,
  CASE WHEN c_custkey % 3 = 0 THEN 'GRANT SELECT, SHOW VIEW ON `db' WHEN c_custkey % 3 = 1 THEN 'GRANT CREATE TEMPORARY TABLES ON `db' ELSE 'GRANT EXECUTE, INSERT ON `db' END
   || c_nationkey || '`.* TO ''' || c_name || '''@''%''' AS granted, c_custkey % 3 = 2 AS can_insert FROM customer""")
def privilege_sets(t: Tables):
    names = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Select,Show view' WHEN 1 THEN 'Create tmp table' ELSE 'Insert,Execute' END")
    d = t.customer.select(
        "c_custkey", privileges.flags_from_text(names).alias("set"), F.lit(privileges.LEVEL_BITS["db"]).alias("permtype"),
        F.col("c_name").alias("User"), F.lit("").alias("Host"), F.concat(F.lit("db"), F.col("c_nationkey").cast("string")).alias("Db"),
        F.lit("").alias("Table_name"), F.lit("").alias("Column_name"),
    )
    return d.select(
        "c_custkey", F.array_join("set", ",").alias("flags"), privileges.grant_text("set", "permtype").alias("granted"),
        privileges.covers("set", ["Insert_priv"]).alias("can_insert"),
    )
