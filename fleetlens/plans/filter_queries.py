"""Event filters, rules and process rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import text
from fleetlens.operators import digest as dg
from fleetlens.operators import filters, ordered, processes, rules
from fleetlens.plans import derived
from fleetlens.plans.derived import CATALOG_SQL, PROC_SQL, VERSION_SQL
from fleetlens.plans.registry import Tables, query, rounded



def _events(t: Tables):
    return t.events.withColumnsRenamed({"user_id": "file", "event_id": "pos"})


@query("since", """
WITH c AS (SELECT user_id, min(event_id) AS p FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT e.event_id AS pos, e.user_id AS file, e.value FROM events e JOIN c ON e.user_id = c.user_id AND e.event_id >= c.p""")
def since(t: Tables):
    return filters.since(_events(t), "ts", F.lit("2024-01-10").cast("timestamp_ntz")).select("pos", "file", "value")


@query("until", """
WITH c AS (SELECT user_id, min(event_id) AS p FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT e.event_id AS pos, e.user_id AS file, e.value FROM events e LEFT JOIN c ON e.user_id = c.user_id WHERE c.p IS NULL OR e.event_id < c.p""")
def until(t: Tables):
    return filters.until(_events(t), "ts", F.lit("2024-01-10").cast("timestamp_ntz")).select("pos", "file", "value")


@query("user_predicate", """
SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 20 AND props LIKE '%9%'""")
def user_predicate(t: Tables):
    return filters.matching(t.events, "event_type = 'error' AND value > 20 AND props LIKE '%9%'").select("event_id", "value")


@query("alias_attributes", f"""
SELECT event_id, coalesce(db, state, command) AS db FROM {PROC_SQL}""")
def alias_attributes(t: Tables):
    return filters.alias_attributes(derived.processes(t).select("event_id", "db", "state", "command"), "db|state|command")


@query("select_attributes", f"""
SELECT event_id, coalesce(db, state) AS db, user FROM {PROC_SQL}""")
def select_attributes(t: Tables):
    return filters.select_attributes(derived.processes(t), ["db:state", "user", "absent"], keep=["event_id"])


@query("default_attributes", f"""
SELECT event_id, server, db, command FROM {PROC_SQL}""")
def default_attributes(t: Tables):
    p = derived.processes(t).select("event_id", "server", "db", "command", F.lit(1).alias("Thread_id"), F.lit("x").alias("ip"))
    return filters.select_attributes(p, [])


@query("inherit_attributes", f"""
SELECT event_id, last_value(db IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS db,
  last_value(big IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS big
FROM (SELECT *, CASE WHEN time > 200 THEN time END AS big FROM {PROC_SQL})""")
def inherit_attributes(t: Tables):
    p = derived.processes(t).select("event_id", "db", F.when(F.col("time") > 200, F.col("time")).alias("big"))
    return filters.inherit_attributes(p, ["db", "big"], ["event_id"], ordered.id_block("event_id"))


@query("sample_per_class", """
SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 3""")
def sample_per_class(t: Tables):
    return filters.sample_per_class(t.events, "event_type", 3, ["event_id"]).select("event_type", "event_id", "value")


@query("zero_admin", f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id END AS Rows_sent FROM events""")
def zero_admin(t: Tables):
    e = t.events.select(
        "event_id", F.col("event_id").alias("Rows_sent"),
        F.when(F.col("event_id") % 7 == 0, "# administrator command: Ping").otherwise("SELECT 1").alias("arg"),
    )
    return filters.zero_admin(e).select("event_id", "Rows_sent")


@query("limit_attribute_value", """
SELECT event_id, coalesce(last_value(CASE WHEN value <= 30 THEN value END IGNORE NULLS) OVER
  (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value FROM events""")
def limit_attribute_value(t: Tables):
    out = filters.limit_attribute_value(t.events, "value", 30, "event_type", ["event_id"], ordered.id_block("event_id"))
    return out.select("event_id", "value")


@query("repair_number", """
SELECT event_id, value FROM events""")
def repair_number(t: Tables):
    doubled = F.concat(F.col("value").cast("string"), F.lit(" Lock_time: 0.00 "), F.col("value").cast("string"))
    return t.events.select("event_id", filters.repair_number(doubled).alias("value"))


@query("by_verb", """
SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')""")
def by_verb(t: Tables):
    return filters.by_verb(t.events, "-*,+CLICK,+ERROR", "event_type").select("event_id", "event_type")


@query("isolate", f"""
SELECT event_id, info FROM {PROC_SQL} WHERE user = 'u3' AND db = 'db1' AND info LIKE '%view%'""")
def isolate(t: Tables):
    return filters.isolate(derived.processes(t), user="u3", db="db1", grep="view", statement="info").select("event_id", "info")


@query("plausible_times", """
SELECT o_orderkey FROM orders WHERE o_totalprice * 1000 < 268435456""")
def plausible_times(t: Tables):
    o = t.orders.withColumn("q", F.col("o_totalprice") * 1000)
    return filters.plausible_times(o, "q").select("o_orderkey")


@query("find_processes", f"""
SELECT event_id FROM {PROC_SQL} WHERE NOT (command = 'Query' AND time < 20) AND NOT coalesce(user LIKE '%system%', false)
  AND coalesce(host LIKE 'h1%' OR host LIKE 'h2%', false) AND coalesce(info LIKE '%error%', false)""")
def find_processes(t: Tables):
    return processes.find_processes(
        derived.processes(t), match={"host": "^h[12]", "info": "error"}, ignore={"user": "system"}, busy_time=20
    ).select("event_id")


@query("busy_or_idle", f"""
SELECT event_id FROM {PROC_SQL} WHERE (command = 'Query' AND time >= 40) OR (command = 'Sleep' AND time >= 60)""")
def busy_or_idle(t: Tables):
    return processes.find_processes(derived.processes(t), busy_time=40, idle_time=60).select("event_id")


@query("oldest_process", f"""
SELECT time FROM {PROC_SQL} WHERE command = 'Query' AND time >= 1 ORDER BY time DESC LIMIT 1""")
def oldest_process(t: Tables):
    return processes.find_processes(derived.processes(t), busy_time=1, only_oldest=True).select("time")


RULES = """
kill Time > 100
pass Time > 200
kill User == 'U3' and Db == 'null'
pass now log Host =~ /^h4/
kill log Command == "connect" or Info =~ /SELECT .*error/i
""".splitlines()

RULES_SQL = f"""
WITH p AS (SELECT *, time > 100 AS r0, time > 200 AS r1, user = 'u3' AND db IS NULL AS r2, host LIKE 'h4%' AS r3,
   command = 'Connect' OR coalesce(info LIKE '%SELECT %error%', false) AS r4 FROM {PROC_SQL})
SELECT event_id, CASE WHEN r3 THEN 'pass' WHEN r4 THEN 'kill' WHEN r2 THEN 'kill' WHEN r1 THEN 'pass' WHEN r0 THEN 'kill' ELSE 'pass' END AS verdict,
  CASE WHEN r3 THEN 3 WHEN r4 THEN 4 WHEN r2 THEN 2 WHEN r1 THEN 1 WHEN r0 THEN 0 END AS rule, r3 OR r4 AS log FROM p"""


@query("rule_verdicts", RULES_SQL)
def rule_verdicts(t: Tables):
    p = derived.processes(t).withColumnsRenamed(
        {"id": "Id", "time": "Time", "user": "User", "host": "Host", "db": "Db", "command": "Command", "state": "State", "info": "Info"}
    )
    out = rules.verdicts(p, rules.read_rules(RULES, p.columns))
    return out.select("event_id", "verdict", "rule", "log")


@query("rules_with_bindings", f"""
SELECT event_id, CASE WHEN time > 150 AND lower(command) = 'query' THEN 'kill' WHEN time > 80 AND lower(command) = 'connect' THEN 'kill' ELSE 'pass' END AS verdict,
  CASE WHEN time > 150 AND lower(command) = 'query' THEN 1 WHEN time > 80 AND lower(command) = 'connect' THEN 0 END AS rule FROM {PROC_SQL}""")
def rules_with_bindings(t: Tables):
    """A name bound to another one's value keeps it when that one is bound anew."""
    lines = ["set long = 80", "set limit = long", "set kind = 'connect'", "kill time > limit and command == kind", "set long = 150", "set limit = long", "set kind = 'Query'", "kill time > limit and command == kind"]
    p = derived.processes(t)
    return rules.verdicts(p, rules.read_rules(lines, p.columns, numeric=("id", "time"))).select("event_id", "verdict", "rule")


@query("rules_with_status", f"""
WITH s AS (SELECT server, count(*) AS threads FROM {PROC_SQL} GROUP BY 1)
SELECT event_id, CASE WHEN threads > 2450 AND time > 50 THEN 'kill' ELSE 'pass' END AS verdict FROM {PROC_SQL} p JOIN s ON p.server = s.server""")
def rules_with_status(t: Tables):
    p = derived.processes(t)
    status = p.groupBy("server").agg(F.count(F.lit(1)).alias("threads"))
    lines = ["kill threads > 2450 and time > 50"]
    found = rules.read_rules(lines, [*p.columns, "threads"], numeric=("time", "threads"))
    return rules.verdicts(p, found, status, ["server"]).select("event_id", "verdict")


@query("find_tables", f"""
SELECT table_name FROM {CATALOG_SQL} WHERE lower(engine) = 'innodb' AND table_name LIKE 'SMALL%' AND data_length + index_length < 12000000 AND data_length + index_length > 9200000""")
def find_tables(t: Tables):
    c = derived.catalog(t).withColumnsRenamed({"table_name": "Name", "engine": "Engine", "data_length": "Data_length", "index_length": "Index_length"})
    return filters.find_tables(c, name="^SMALL", engine="innodb", smaller_than=12000000, greater_than=9200000).select(F.col("Name").alias("table_name"))


@query("find_tables_by_age", """
SELECT DISTINCT 'log_' || strftime(o_orderdate, '%Y%m%d') AS name FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def find_tables_by_age(t: Tables):
    c = t.orders.select(
        F.date_format("o_orderdate", "'log_'yyyyMMdd").alias("Name"), F.lit("InnoDB").alias("Engine"), F.lit("Compact").alias("Row_format"),
        F.lit(0).alias("Data_length"), F.lit(0).alias("Index_length"),
    ).distinct()
    day = lambda d: F.lit(d).cast("timestamp")
    out = filters.find_tables(c, age_pattern="log_%Y%m%d", older_than=day("1996-06-01"), newer_than=day("1996-01-01"))
    return out.select(F.col("Name").alias("name"))


@query("report_ignore", f"""
SELECT id FROM {CATALOG_SQL} WHERE NOT (server || '.' || database_name || '.' || table_name LIKE 's1.%' OR regexp_matches(server || '.' || database_name || '.' || table_name, 'Brand#1\\d\\.'))""")
def report_ignore(t: Tables):
    return filters.report_ignore(derived.catalog(t), [r"^s1\.", r"Brand#1\d\."]).select("id")


@query("search_hierarchy", f"""
SELECT 'table' AS kind, server, database_name, table_name FROM {CATALOG_SQL} WHERE server || '.' || database_name || '.' || table_name LIKE '%s2%'
UNION ALL SELECT DISTINCT 'server', server, NULL, NULL FROM {CATALOG_SQL} WHERE server LIKE '%s2%'""")
def search_hierarchy(t: Tables):
    c = derived.catalog(t)
    return filters.search_hierarchy(c, c.select("server").distinct(), "s2")


@query("exclude_system", f"""
SELECT id FROM {CATALOG_SQL} WHERE database_name NOT IN ('information_schema', 'mysql', 'performance_schema', 'Brand#1')""")
def exclude_system(t: Tables):
    return filters.exclude_system(derived.catalog(t), more=("Brand#1",)).select("id")


@query("history_filter", f"""
WITH h AS (SELECT event_type, user_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2)
SELECT event_type, user_id, value FROM h WHERE value >= 10 AND props LIKE '%5%'""")
def history_filter(t: Tables):
    h = t.events.groupBy("event_type", "user_id").agg(F.max_by("value", "event_id").alias("value"), F.max_by("props", "event_id").alias("props"))
    return filters.by_history(filters.by_history(h, "value", ">=", 10), "props", "=~", "5").drop("props")


@query("changed_settings", """
SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END IS DISTINCT FROM 'F'""")
def changed_settings(t: Tables):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("value"), F.lit("F").alias("default"))
    return filters.changed_settings(o).select("o_orderkey")


@query("active_processes", f"""
SELECT event_id, time FROM {PROC_SQL} WHERE command NOT IN ('Sleep', 'Binlog Dump')""")
def active_processes(t: Tables):
    return filters.active_processes(derived.processes(t)).select("event_id", "time")


@query("table_access", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS k, l_suppkey FROM lineitem),
a AS (SELECT CASE k WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'read' END AS access, CASE k WHEN 2 THEN 'b' ELSE 't' END || l_suppkey AS tbl,
  l_orderkey, l_linenumber FROM s)
SELECT tbl AS "table", arg_min(access, (l_orderkey, l_linenumber, access)) AS access FROM a GROUP BY 1""")
def table_access(t: Tables):
    sup = F.col("l_suppkey").cast("string")
    k = F.col("l_linenumber") % 3
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT a FROM t"), sup)).when(k == 1, F.concat(F.lit("UPDATE t"), sup, F.lit(" SET a = 1")))
        .otherwise(F.concat(F.lit("SELECT a FROM b"), sup))
    )
    s = t.lineitem.select("l_orderkey", "l_linenumber", sql.alias("sql"))
    s = s.select("l_orderkey", "l_linenumber", text.query_type("sql").alias("rw"), text.get_tables("sql").alias("tables"))
    # Ties on (order, line) are told apart by the access kind.
    return dg.table_access(s, "rw", "tables", ["l_orderkey", "l_linenumber", "rw"])


# --- process lists ----------------------------------------------------------------------


@query("process_counts", f"""
WITH p AS (SELECT unnest([{{'f': 'user', 'v': coalesce(user, 'NULL')}}, {{'f': 'host', 'v': coalesce(split_part(host, ':', 1), 'NULL')}},
  {{'f': 'db', 'v': coalesce(db, 'NULL')}}, {{'f': 'command', 'v': coalesce(lower(command), 'NULL')}}, {{'f': 'state', 'v': coalesce(lower(state), 'NULL')}}]) AS x, time FROM {PROC_SQL})
SELECT x.f AS field, x.v AS value, count(*) AS count, CAST(sum(time) AS BIGINT) AS time FROM p GROUP BY 1, 2""")
def process_counts(t: Tables):
    return processes.counts_by_field(derived.processes(t))


@query("process_state_counts", f"""
SELECT server, count(*) FILTER (state = 'Locked') AS State_locked, count(*) FILTER (state = 'Sending data') AS State_sending_data,
  count(*) FILTER (state = '') AS State_none, count(*) FILTER (state IS NULL) AS State_other, 0 AS State_init FROM {PROC_SQL} GROUP BY 1""")
def process_state_counts(t: Tables):
    return processes.state_counts(derived.processes(t), ["server"]).select(
        "server", "State_locked", "State_sending_data", "State_none", "State_other", "State_init")


@query("process_log_rows", f"""
SELECT event_id, 'db1' AS server, lower(command) AS command, lower(state) AS state, DATE '2024-02-01' AS event_date FROM {PROC_SQL}""")
def process_log_rows(t: Tables):
    out = processes.log_rows(derived.processes(t), "db1", "2024-02-01 10:00:00")
    return out.select("event_id", "server", "command", "state", "event_date")


#: Hourly samples of twenty connections on three servers: texts that hold for half a day, times that drift, jump back or have fractions, and connections that vanish.
SESSION_SAMPLES = """
  s AS (SELECT user_id % 20 AS id, epoch_us(date_trunc('hour', ts)) AS now, min(event_id) AS e FROM events GROUP BY 1, 2),
  d AS (SELECT 's' || id % 3 AS server, id, now, CASE WHEN e % 13 > 0 THEN 'q' || (now // 43200000000 + id) % 3 END AS info,
    CASE WHEN e % 11 = 0 THEN 5000000 ELSE now % 43200000000 + (e % 4) * 700000 + CASE WHEN e % 3 > 0 THEN 300000 * (e % 4) ELSE 0 END END AS time, (e % 2) * 100000 AS etime FROM s)"""
SESSIONS_SQL = f"""
WITH RECURSIVE {SESSION_SAMPLES},
  t AS (SELECT server, now, lead(now) OVER w AS nxt, lag(now) OVER w AS prv FROM (SELECT DISTINCT server, now FROM d) WINDOW w AS (PARTITION BY server ORDER BY now)),
  r AS (SELECT d.*, t.nxt, t.prv, row_number() OVER w AS rn, lag(d.now) OVER w AS pnow, lag(info) OVER w AS pinfo
    FROM d JOIN t ON t.server = d.server AND t.now = d.now WHERE info IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY d.now)),
  w AS (
    SELECT id, rn, rn AS h, time AS ht, (now - time) // 1000000 * 1000000 + etime AS hs FROM r WHERE rn = 1
    UNION ALL
    SELECT id, rn, CASE WHEN brk THEN rn ELSE h END, CASE WHEN brk THEN time ELSE ht END, CASE WHEN brk THEN (now - time) // 1000000 * 1000000 + etime ELSE hs END
    FROM (
      SELECT r.*, w.h, w.ht, w.hs, r.pnow IS DISTINCT FROM r.prv OR r.pinfo <> r.info OR r.time < w.ht
        OR r.now - r.time - r.etime - w.hs > CASE WHEN r.time % 1000000 = 0 THEN 1000000 ELSE 1000 END AS brk
      FROM w JOIN r ON r.id = w.id AND r.rn = w.rn + 1
    )
  )
SELECT w.id, arg_min(r.server, r.rn) AS server, make_timestamp(min(r.now)) AS first_seen, any_value(r.info) AS arg, count(*) AS samples,
  round(greatest(arg_min(r.time, r.rn), max(r.nxt) - min(r.now)) / 1e6, 6) AS "Query_time"
FROM w JOIN r ON r.id = w.id AND r.rn = w.rn GROUP BY w.id, w.h HAVING arg_max(r.nxt IS NOT NULL, r.rn)"""


def session_samples(t: Tables):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    s = t.events.groupBy((F.col("user_id") % 20).alias("id"), hour.alias("ts")).agg(F.min("event_id").alias("e"))
    now, e = F.unix_micros("ts"), F.col("e")
    half_day = F.lit(43_200_000_000)
    drift = (e % 4) * 700_000 + F.when(e % 3 > 0, (e % 4) * 300_000).otherwise(0)
    return s.select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("server"), "id", "ts",
        F.when(e % 13 > 0, F.concat(F.lit("q"), (F.floor(now / half_day) + F.col("id")) % 3)).alias("info"),
        (F.when(e % 11 == 0, 5_000_000).otherwise(now % half_day + drift) / 1e6).alias("time"), ((e % 2) * 0.1).alias("etime"),
    )


def session_columns(df):
    out = df.select("id", "server", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "arg", "samples", "Query_time")
    return rounded(out, 6, "Query_time")


@query("process_sessions", SESSIONS_SQL)
def process_sessions(t: Tables):
    return session_columns(processes.sessions(session_samples(t)))
