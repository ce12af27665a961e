"""Logs, packets and status texts written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import digest as dg
from fleetlens.operators import lineage, ordered
from fleetlens.plans.registry import Tables, query, rounded
from fleetlens.sources import logs, packets, records, status, tables
from fleetlens.sources.buckets import BucketTable



def _slow_events(t: Tables):
    return t.events.select(
        "event_id", F.col("user_id").alias("file"), F.date_format("ts", "yyMMdd HH:mm:ss").alias("ts"),
        F.concat(F.lit("u"), "user_id").alias("user"), F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"), F.col("user_id").alias("Thread_id"),
        F.col("value").alias("Query_time"), (F.col("event_id") % 100).alias("Rows_sent"), F.lit("Yes").alias("QC_Hit"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("db"), F.col("event_id") % 3)).alias("db"),
        F.when(F.col("event_id") % 11 == 0, "administrator command: Quit")
        .otherwise(F.concat(F.lit("SELECT *\nFROM "), "event_type", F.lit(" WHERE id = "), "event_id", F.lit(" /* page: p"), F.col("event_id") % 9, F.lit(" */"))).alias("arg"),
    )


def _slow_records(t: Tables):
    """``events`` as slow-log records: ``;\\n#`` is cut off, as the reader does."""
    e = _slow_events(t)
    text = logs.slow_log_text(e)
    record = F.when(F.col("event_id") < 50, text).otherwise(F.substr(text, F.lit(2)))
    return e.select("file", F.col("event_id").alias("pos"), F.regexp_replace(record, r";\z", "").alias("value"))


SLOW_TEXT = """'# Time: ' || strftime(ts, '%y%m%d %H:%M:%S') || chr(10) || '# User@Host: u' || user_id || '[u' || user_id || '] @ h' || user_id % 5 || ' []' || chr(10)
  || '# Thread_id: ' || user_id || chr(10) || '# Query_time: ' || printf('%.6f', value) || '  Lock_time: 0.000000  Rows_sent: ' || event_id % 100 || '  Rows_examined: 0' || chr(10)
  || '# QC_Hit: Yes  Full_scan: No  Full_join: No  Tmp_table: No  Disk_tmp_table: No' || chr(10) || '# Filesort: No  Disk_filesort: No  Merge_passes: 0' || chr(10)
  || CASE WHEN event_id % 3 > 0 THEN 'use db' || event_id % 3 || ';' || chr(10) ELSE '' END
  || CASE WHEN event_id % 11 = 0 THEN '# administrator command: Quit' ELSE 'SELECT *' || chr(10) || 'FROM ' || event_type || ' WHERE id = ' || event_id || ' /* page: p' || event_id % 9 || ' */' END || ';'"""


SLOW_SQL = """
SELECT event_id AS pos, strftime(ts, '%y%m%d %H:%M:%S') AS ts, 'u' || user_id || '[u' || user_id || '] ' AS account, 'h' || user_id % 5 AS host,
  CASE WHEN event_id % 3 > 0 THEN 'db' || event_id % 3 END AS db, CASE WHEN event_id % 11 = 0 THEN 'Admin' ELSE 'Query' END AS cmd,
  CASE WHEN event_id % 11 = 0 THEN '# administrator command: Quit' ELSE 'SELECT *' || chr(10) || 'FROM ' || event_type || ' WHERE id = ' || event_id || ' /* page: p' || event_id % 9 || ' */' END AS arg,
  value AS Query_time, CAST(event_id % 100 AS DOUBLE) AS Rows_sent, CAST(user_id AS DOUBLE) AS Thread_id, 'Yes' AS qc, CASE WHEN event_id % 11 > 0 THEN 'p' || event_id % 9 END AS page FROM events"""


@query("slow_log_events", SLOW_SQL.replace("'u' || user_id || '[u' || user_id || '] ' AS account", "'u' || user_id AS \"user\""))
def slow_log_events(t: Tables):
    e = logs.parse_slow_log(_slow_records(t), r"/\*.*?\*/", r"(\w+): (\w+)")
    return e.select(
        "pos", "ts", "user", "host", "db", "cmd", "arg", "Query_time", "Rows_sent", "Thread_id", F.col("attrs")["QC_Hit"].alias("qc"), F.col("attrs")["page"].alias("page"))


@query("slow_log_digest", """
SELECT 'select * from ' || event_type || ' where id = ? ' AS fingerprint, count(*) AS cnt, round(sum(value), 4) AS sum, max(value) AS max
FROM events WHERE event_id % 11 > 0 GROUP BY 1 UNION ALL SELECT '# administrator command: Quit', count(*), round(sum(value), 4), max(value) FROM events WHERE event_id % 11 = 0""")
def slow_log_digest(t: Tables):
    from fleetlens.functions import text

    e = logs.parse_slow_log(_slow_records(t)).select("arg", "Query_time")
    out = dg.rewritten_digest(e, "arg", text.fingerprint, "fingerprint", ["Query_time"]).select("fingerprint", "cnt", "sum", "max")
    return rounded(out, 4, "sum")


@query("slow_log_text", f"SELECT event_id AS pos, {SLOW_TEXT} AS value FROM events")
def slow_log_text(t: Tables):
    e = _slow_events(t)
    return e.select(F.col("event_id").alias("pos"), logs.slow_log_text(e).alias("value"))


GENERAL_KIND = "CASE event_id % 6 WHEN 0 THEN 'Connect' WHEN 3 THEN 'Init' WHEN 5 THEN 'Quit' ELSE 'Query' END"
GENERAL_SQL = f"""
WITH e AS (SELECT *, {GENERAL_KIND} AS k, CASE WHEN event_id % 18 = 6 THEN NULL ELSE 'db' || event_id % 4 END AS d FROM events),
x AS (SELECT *, CASE WHEN k = 'Connect' AND event_id % 18 <> 12 THEN coalesce(d, '') WHEN k = 'Init' THEN 'i' || event_id % 4 END AS sets FROM e),
y AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM x)
SELECT event_id * 1000 AS pos, CAST(user_id AS VARCHAR) AS Thread_id, CASE WHEN k = 'Query' THEN 'Query' ELSE 'Admin' END AS cmd,
  CASE WHEN k = 'Query' THEN 'SELECT ' || event_id || chr(10) || '  FROM t' WHEN k = 'Init' THEN 'administrator command: Init DB'
   WHEN k = 'Connect' AND event_id % 18 = 12 THEN 'administrator command: Access denied for user' ELSE 'administrator command: ' || k END AS arg,
  CASE WHEN k = 'Query' THEN nullif(cur, '') WHEN k = 'Init' THEN 'i' || event_id % 4 WHEN k = 'Connect' AND event_id % 18 <> 12 THEN d END AS db,
  CASE WHEN k = 'Connect' AND event_id % 18 <> 12 THEN 'bob' END AS "user", CASE WHEN k = 'Connect' AND event_id % 18 <> 12 THEN 'web' || event_id % 3 END AS host FROM y"""


def _general_lines(t: Tables):
    kind = F.expr(GENERAL_KIND)
    eid = F.col("event_id")
    db = F.when(eid % 18 == 6, "").otherwise(F.concat(F.lit(" db"), eid % 4))
    arg = (
        F.when(kind == "Query", F.concat(F.lit("SELECT "), eid))
        .when(kind == "Init", F.concat(F.lit("DB\ti"), eid % 4))
        .when((kind == "Connect") & (eid % 18 == 12), "Access denied for user")
        .when(kind == "Connect", F.concat(F.lit("bob@web"), eid % 3, F.lit(" on"), db)).otherwise("")
    )
    stamp = F.when(eid % 2 == 0, F.date_format("ts", "yyMMdd HH:mm:ss")).otherwise("\t")
    first = F.concat(stamp, F.lit("\t     "), "user_id", F.lit(" "), kind, F.lit("\t"), arg)
    more = F.when(kind == "Query", F.lit("  FROM t"))
    lines = F.array_compact(F.array(first, more))
    x = t.events.select("event_id", F.posexplode(lines).alias("_i", "value"))
    return x.select(F.lit("general").alias("file"), (F.col("event_id") * 1000 + F.col("_i")).alias("pos"), "value")


@query("general_log_events", GENERAL_SQL)
def general_log_events(t: Tables):
    out = logs.parse_general_log(_general_lines(t))
    return out.select("pos", "Thread_id", "cmd", "arg", "db", "user", "host")


BINLOG_SQL = """
SELECT o_orderkey AS pos, CAST(o_orderkey * 100 AS VARCHAR) AS "offset", strftime(o_orderdate, '%y%m%d %-H:%M:%S') AS ts, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) END AS Xid,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 90 AS VARCHAR) END AS Thread_id, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS Query_time,
  CASE WHEN o_orderkey % 5 > 0 THEN 'db' || o_orderkey % 3 END AS db, CASE WHEN o_orderkey % 5 = 0 THEN 'COMMIT' ELSE 'INSERT INTO t' || chr(10) || 'VALUES (' || o_orderkey || ')' END AS arg,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey + 1000 AS VARCHAR) END AS stamp FROM orders"""


def _binlog_records(t: Tables):
    k = F.col("o_orderkey")
    head = F.concat(
        F.when(k < 10, F.lit("DELIMITER /*!*/;\n# at ")).otherwise(F.lit(" at ")), (k * 100).cast("string"), F.lit("\n#"), F.date_format("o_orderdate", "yyMMdd H:mm:ss"),
        F.lit(" server id 1  end_log_pos "), k.cast("string"), F.lit(" \t"),
    )
    body = F.when(k % 5 == 0, F.concat(F.lit("Xid = "), "o_custkey", F.lit("\nCOMMIT/*!*/"))).otherwise(F.concat(
        F.lit("Query\tthread_id="), F.col("o_custkey") % 90, F.lit("\texec_time="), k % 7, F.lit("\terror_code=0\nuse db"), k % 3,
        F.lit("/*!*/;\nSET TIMESTAMP="), k + 1000, F.lit("/*!*/;\nINSERT INTO t\nVALUES ("), k, F.lit(")\n/*!*/")))
    return t.orders.select((k % 10).cast("string").alias("file"), k.alias("pos"), F.concat(head, body).alias("value"))


def _binlog_columns(out):
    return out.select("pos", "offset", "ts", "Xid", "Thread_id", "Query_time", "db", "arg", F.col("attrs")["timestamp"].alias("stamp"))


@query("binlog_events", BINLOG_SQL)
def binlog_events(t: Tables):
    return _binlog_columns(logs.parse_binlog_text(_binlog_records(t)))


@query("raw_statements", """
WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'db' || event_id % 9 END AS u FROM events)
SELECT event_id AS pos, last_value(u IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS db, 'DELETE' AS verb, 'DELETE FROM t' || event_id AS sql, event_id % 4 AS k
FROM s QUALIFY k IN (1, 2)""".replace(", event_id % 4 AS k\nFROM s QUALIFY k IN (1, 2)", "\nFROM s QUALIFY event_id % 4 IN (1, 2)"))
def raw_statements(t: Tables):
    k = F.col("event_id") % 4
    sql = F.when(k == 0, F.concat(F.lit("USE `db"), F.col("event_id") % 9, F.lit("`"))).when(k == 3, "EXPLODE x").otherwise(F.concat(F.lit(" DELETE FROM t"), "event_id"))
    r = t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), sql.alias("value"))
    return logs.parse_raw_statements(r).select("pos", "db", "verb", "sql")


@query("compound_statements", """
SELECT o_orderkey, 0 AS part, 'UPDATE t SET a = ' || o_custkey AS sql FROM orders UNION ALL SELECT o_orderkey, 2, 'SELECT ' || o_orderkey FROM orders""")
def compound_statements(t: Tables):
    sql = F.concat(F.lit("UPDATE t SET a = "), "o_custkey", F.lit(";\nNONSENSE 1;\n SELECT "), "o_orderkey", F.lit(";"))
    return logs.split_compound(t.orders.select("o_orderkey", sql.alias("sql"))).select("o_orderkey", "part", "sql")


def _hex_records(t: Tables):
    """``events`` as dumped packets: 20-byte IP and TCP headers and a text payload."""
    payload = F.hex(F.encode(F.concat(F.lit("get key"), "event_id", F.lit("\r\n")), "UTF-8"))
    size = (F.length(payload) / 2).cast("int")
    word = lambda n, digits: F.lower(F.lpad(F.hex(n), digits, "0"))
    ip = F.concat(F.lit("4500"), word(size + 40, 4), F.lit("00000000400600000a0000010a000002"))
    tcp = F.concat(F.lit("c0002bcb"), word(F.col("event_id"), 8), word(F.col("user_id"), 8), F.lit("50"), word(F.col("event_id") % 8, 2), F.lit("ffff00000000"))
    dump = F.regexp_replace(F.concat(ip, tcp, F.lower(payload)), "(.{4})", " $1")
    # An odd last byte stands alone; a space goes before it.
    rest = F.length(F.concat(ip, tcp, payload)) % 4
    dump = F.when(rest == 2, F.regexp_replace(dump, r"(..)\z", " $1")).otherwise(dump)
    line = F.concat(F.date_format("ts", "yy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" IP 10.0.0."), F.col("user_id") % 200, F.lit(".4"), F.col("event_id") % 100, F.lit(" > 10.0.0.2.memcached: tcp"))
    return t.events.select(F.lit("dump").alias("file"), F.col("event_id").alias("pos"), F.concat(line, F.lit("\n\t0x0000: "), dump).alias("value"))


PACKET_SQL = """
SELECT event_id AS pos, '20' || strftime(ts, '%y-%m-%d %H:%M:%S.%f') AS ts, '10.0.0.' || user_id % 200 AS src_host, '4' || event_id % 100 AS src_port, '11211' AS dst_port,
  event_id AS seq, user_id AS ack, (event_id % 8) % 2 = 1 AS fin, (event_id % 8) // 2 % 2 = 1 AS syn, (event_id % 8) // 4 = 1 AS rst, true AS complete,
  9 + length(CAST(event_id AS VARCHAR)) AS data_len, 'get key' || event_id || chr(13) || chr(10) AS payload FROM events"""


def _packet_columns(p):
    return p.select(
        "pos", "ts", "src_host", "src_port", "dst_port", "seq", "ack", "fin", "syn", "rst", "complete", "data_len", F.decode(F.unhex("data"), "UTF-8").alias("payload"))


@query("packet_fields", PACKET_SQL)
def packet_fields(t: Tables):
    return _packet_columns(packets.parse_packets(_hex_records(t)))


def _packet(client_side, ts, pos, seq, data, port="11211"):
    """Packet columns from a client or its server."""
    me, server = F.concat(F.lit("10.1.0."), F.col("cl")), F.lit("10.0.0.2")
    a, b = (me, server) if client_side else (server, me)
    pa, pb = (F.lit("4000"), F.lit(port)) if client_side else (F.lit(port), F.lit("4000"))
    return F.struct(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), pos.alias("pos"), seq.cast("long").alias("seq"), a.alias("src_host"), pa.alias("src_port"),
        b.alias("dst_host"), pb.alias("dst_port"), F.octet_length(data).alias("data_len"), F.lower(F.hex(F.encode(data, "ISO-8859-1"))).alias("data"),
    )


@query("key_value_requests", """
WITH e AS (SELECT *, event_id % 7 AS k, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nts FROM events)
SELECT event_id * 10 AS pos, '10.1.0.' || user_id || ':4000' AS client, CASE WHEN k = 3 THEN 'set' WHEN k = 4 THEN 'incr' ELSE 'get' END AS cmd, 'key' || event_id AS "key",
  CASE WHEN k = 0 THEN 'INTERRUPTED' WHEN k = 1 THEN 'NOT_FOUND' WHEN k = 3 THEN 'STORED' WHEN k = 4 THEN '' ELSE 'VALUE' END AS res,
  CASE WHEN k = 3 THEN 'abcde' WHEN k = 4 THEN CAST(event_id AS VARCHAR) WHEN k IN (2, 5, 6) THEN 'xy' || event_id % 10 ELSE '' END AS val,
  round(CASE WHEN k = 0 THEN (epoch_us(nts) - epoch_us(ts)) / 1e6 ELSE CASE WHEN k = 5 THEN 0.002 ELSE 0.001 END END, 6) AS Query_time
FROM e WHERE k <> 0 OR nts IS NOT NULL""")
def key_value_requests(t: Tables):
    k, eid = F.col("event_id") % 7, F.col("event_id")
    at = F.col("ts").cast("timestamp")
    later = lambda ms: F.timestamp_micros(F.unix_micros(at) + ms * 1000)
    crlf = F.lit("\r\n")
    key = F.concat(F.lit("key"), eid)
    val = F.concat(F.lit("xy"), eid % 10)
    ask = F.when(k == 3, F.concat(F.lit("set "), key, F.lit(" 0 60 5\r\nabcde\r\n"))).when(k == 4, F.concat(F.lit("incr "), key, F.lit(" 1\r\n"))).otherwise(F.concat(F.lit("get "), key, crlf))
    found = F.concat(F.lit("VALUE "), key, F.lit(" 0 3\r\n"))
    answer = (
        F.when(k == 1, "END\r\n").when(k == 3, "STORED\r\n").when(k == 4, F.concat(eid.cast("string"), crlf))
        .when(k == 5, F.concat(found, F.lit("x"))).when(k > 0, F.concat(found, val, F.lit("\r\nEND\r\n")))
    )
    rest = F.when(k == 5, F.concat(F.substring(val, 2, 2), F.lit("\r\nEND\r\n")))
    base = t.events.withColumn("cl", F.col("user_id"))
    p = base.select(F.inline(F.array_compact(F.array(
        _packet(True, at, eid * 10, eid * 3, ask), F.when(answer.isNotNull(), _packet(False, later(1), eid * 10 + 1, eid * 3 + 1, answer)),
        F.when(rest.isNotNull(), _packet(False, later(2), eid * 10 + 2, eid * 3 + 2, rest)),
    ))))
    out = packets.key_value_requests(p, order=("pos",), block=ordered.id_block("pos"))
    return rounded(out.select("pos", "client", "cmd", "key", "res", "val", "Query_time"), 6, "Query_time")


@query("http_requests", """
SELECT page_id * 10 AS pos, 'get www.example.com/p' || page_id AS arg, '200' AS Status_code, 10 AS bytes, 0.003 AS Query_time, 0.002 AS Transmit_time FROM pages""")
def http_requests(t: Tables):
    pid = F.col("page_id")
    at = lambda ms: F.timestamp_micros((pid * 10_000_000 + ms * 1000).cast("long"))
    ask = F.concat(F.lit("GET /p"), pid, F.lit(" HTTP/1.1\r\nHost: www.example.com\r\n\r\n"))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n01234")
    tail = F.lit("56789")
    swapped = pid % 2 == 1
    base = t.pages.withColumn("cl", pid % 20)
    p = base.select(F.inline(F.array(
        _packet(True, at(0), pid * 10, pid * 3, ask, "80"),
        _packet(False, at(3), pid * 10 + 1, F.when(swapped, 2).otherwise(1), F.when(swapped, tail).otherwise(head), "80"),
        _packet(False, at(5), pid * 10 + 2, F.when(swapped, 1).otherwise(2), F.when(swapped, head).otherwise(tail), "80"),
    )))
    out = packets.http_requests(p, order=("pos",), block=ordered.id_block("pos"))
    return rounded(out.select("pos", "arg", "Status_code", "bytes", "Query_time", "Transmit_time"), 4, "Query_time", "Transmit_time")


@query("engine_status", """
WITH m AS (SELECT o_orderkey, unnest([{'m': 'spin_waits', 'v': o_custkey + 7}, {'m': 'spin_rounds', 'v': 5}, {'m': 'os_waits', 'v': 9}, {'m': 'innodb_lsn', 'v': o_custkey * 4294967296 + 500},
  {'m': 'flushed_to', 'v': o_custkey * 4294967296 + 100}, {'m': 'unflushed_log', 'v': 400}, {'m': 'pages_read', 'v': o_orderkey}, {'m': 'pages_created', 'v': 2}, {'m': 'pages_written', 'v': 3},
  {'m': 'current_transactions', 'v': 2}, {'m': 'active_transactions', 'v': 1}, {'m': 'file_reads', 'v': 11}, {'m': 'file_writes', 'v': 12}, {'m': 'file_fsyncs', 'v': 13}]) AS x FROM orders)
SELECT o_orderkey, x.m AS metric, CAST(x.v AS VARCHAR) AS value FROM m""")
def engine_status(t: Tables):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    text = F.concat(
        F.lit("Mutex spin waits "), c, F.lit(", rounds 5, OS waits 4\nRW-shared spins 3, OS waits 2; RW-excl spins 4, OS waits 3\n"),
        F.lit("---TRANSACTION 0 1, not started\n---TRANSACTION 0 2, ACTIVE 5 sec\nPages read "), k, F.lit(", created 2, written 3\n"),
        F.lit("11 OS file reads, 12 OS file writes, 13 OS fsyncs\nLog sequence number "), c, F.lit(" 500\nLog flushed up to   "), c, F.lit(" 100\n"),
    )
    out = status.status_metrics(t.orders.select("o_orderkey", text.alias("text")), ["o_orderkey"])
    return out.withColumn("value", F.col("value").cast("string"))


@query("insert_statements", r"""
SELECT 'INSERT INTO `customer` (`c_custkey`,`c_name`,`c_mktsegment`) VALUES (' || c_custkey || ',''' || c_name || '\''s'',' || CASE WHEN c_mktsegment = 'MACHINERY' THEN 'NULL' ELSE '''' || c_mktsegment || '''' END || ');' AS value FROM customer""")
def insert_statements(t: Tables):
    c = t.customer.select(
        "c_custkey", F.concat("c_name", F.lit("'s")).alias("c_name"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"))
    return tables.insert_statements(c, "customer")


@query("usage_rows", """
SELECT event_type, count(*) AS n, DATE '2024-02-01' AS collected_date FROM events GROUP BY 1""")
def usage_rows(t: Tables):
    counters = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return tables.usage_rows(counters, "2024-02-01 03:00:00").drop("collected_at")


@query("delimited_load", """
SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, c_acctbal FROM customer""")
def delimited_load(t: Tables):
    """Customers written as delimited text with a token for NULL, and loaded."""
    folder = lineage.shared_dir(t.spark, "delimited")
    name = F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("null")
    t.customer.select(F.concat_ws("\t", "c_custkey", name, "c_acctbal").alias("value")).write.text(folder)
    return tables.read_delimited(t.spark, folder, "c_custkey long, c_name string, c_acctbal double")


@query("nested_documents", """
SELECT 's' || c_custkey AS server, CAST(c_nationkey AS VARCHAR) AS version, 'c' || c_nationkey AS cluster FROM customer""")
def nested_documents(t: Tables):
    """One topology document per customer, written as JSON and flattened."""
    folder = lineage.shared_dir(t.spark, "documents")
    server = F.struct(F.col("c_nationkey").cast("string").alias("version"), F.array(F.concat(F.lit("c"), "c_nationkey")).alias("readfor"))
    doc = F.struct(F.create_map(F.concat(F.lit("s"), "c_custkey"), server).alias("servers"))
    t.customer.select(F.to_json(doc).alias("value")).write.text(folder)
    servers, _ = tables.flatten_documents(t.spark.read.schema(tables.DOCUMENT_SCHEMA).json(folder))
    return servers.select("server", "version", F.explode("readfor").alias("cluster"))


@query("replaced_table", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 5 = 0""")
def replaced_table(t: Tables):
    """Rows appended in two parts, loaded into a table, which is then overwritten by a result computed from itself."""
    folder, table = lineage.shared_dir(t.spark, "appended"), BucketTable(t.spark, lineage.shared_dir(t.spark, "table"), ["o_orderkey"], 16)
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).otherwise(0.0).alias("o_totalprice"))
    for rest in (0, 1):
        tables.append_rows(rows.filter(F.col("o_orderkey") % 2 == rest), folder)
    table.replace(t.spark.read.parquet(folder))
    table.replace(table.read().withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(0.0)))
    return table.read()


# --- logs written from the tables and read by path ---------------------------------------


def _stored(t: Tables, rows, name: str, separator: str = "\n") -> str:
    """A folder of logs: the rows (part, pos, value), one folder per part, in order."""
    folder = lineage.shared_dir(t.spark, name)
    records.write_records(rows, folder, "part", ["pos"], "value", separator)
    return f"{folder}/*"


def _before(size: str, part: str, order: str) -> str:
    """Bytes of a part's records before each one, from the bytes each takes with its separator."""
    return f"CAST(coalesce(sum({size}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


def _bytes(text: str) -> str:
    return f"octet_length(encode({text}))"


SLOW_FILES_SQL = f"""
WITH p AS (SELECT event_id, {_before(_bytes(SLOW_TEXT) + " + 1", "user_id", "event_id")} AS at FROM events)
SELECT CASE WHEN p.at > 0 THEN p.at + 1 ELSE 0 END AS pos, s.* EXCLUDE (pos)
FROM ({SLOW_SQL.replace("'u' || user_id || '[u' || user_id || '] ' AS account", "'u' || user_id AS " + chr(34) + "user" + chr(34))}) s JOIN p ON p.event_id = s.pos"""


@query("slow_log_files", SLOW_FILES_SQL)
def slow_log_files(t: Tables):
    e = _slow_events(t)
    stored = _stored(t, e.select(F.col("file").alias("part"), F.col("event_id").alias("pos"), logs.slow_log_text(e).alias("value")), "slow")
    e = logs.read_slow_log(t.spark, stored, r"/\*.*?\*/", r"(\w+): (\w+)")
    return e.select("pos", "ts", "user", "host", "db", "cmd", "arg", "Query_time", "Rows_sent", "Thread_id", F.col("attrs")["QC_Hit"].alias("qc"), F.col("attrs")["page"].alias("page"))


GENERAL_FILES_SQL = f"""
WITH e AS (SELECT *, {GENERAL_KIND} AS k FROM events),
l AS (
  SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%y%m%d %H:%M:%S') ELSE chr(9) END || chr(9) || '     ' || user_id || ' ' || k || chr(9)
    || CASE WHEN k = 'Query' THEN 'SELECT ' || event_id WHEN k = 'Init' THEN 'DB' || chr(9) || 'i' || event_id % 4 WHEN k = 'Connect' AND event_id % 18 = 12 THEN 'Access denied for user'
       WHEN k = 'Connect' THEN 'bob@web' || event_id % 3 || ' on' || CASE WHEN event_id % 18 = 6 THEN '' ELSE ' db' || event_id % 4 END ELSE '' END
    || CASE WHEN k = 'Query' THEN chr(10) || '  FROM t' ELSE '' END AS line
  FROM e
),
p AS (SELECT event_id, {_before(_bytes("line") + " + 1", "user_id", "event_id")} AS at FROM l)
SELECT p.at AS pos, g.* EXCLUDE (pos) FROM ({GENERAL_SQL}) g JOIN p ON p.event_id * 1000 = g.pos"""


@query("general_log_files", GENERAL_FILES_SQL)
def general_log_files(t: Tables):
    lines = _general_lines(t).withColumn("event_id", F.floor(F.col("pos") / 1000)).join(t.events.select("event_id", F.col("user_id").alias("part")), "event_id")
    out = logs.read_general_log(t.spark, _stored(t, lines, "general"))
    return out.select("pos", "Thread_id", "cmd", "arg", "db", "user", "host")


RAW_TEXT = "CASE event_id % 4 WHEN 0 THEN 'USE `db' || event_id % 9 || '`' WHEN 3 THEN 'EXPLODE x' ELSE 'DELETE FROM t' || event_id END"


@query("raw_statement_files", f"""
WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN 'db' || event_id % 9 END AS u, {_before(_bytes(RAW_TEXT) + " + 2", "user_id", "event_id")} AS pos FROM events)
SELECT pos, last_value(u IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS db, 'DELETE' AS verb, 'DELETE FROM t' || event_id AS sql
FROM s QUALIFY event_id % 4 IN (1, 2)""")
def raw_statement_files(t: Tables):
    k = F.col("event_id") % 4
    sql = F.when(k == 0, F.concat(F.lit("USE `db"), F.col("event_id") % 9, F.lit("`"))).when(k == 3, "EXPLODE x").otherwise(F.concat(F.lit("DELETE FROM t"), "event_id"))
    rows = t.events.select(F.col("user_id").alias("part"), F.col("event_id").alias("pos"), sql.alias("value"))
    return logs.read_raw_statements(t.spark, _stored(t, rows, "raw", logs.STATEMENT_SEPARATOR)).select("pos", "db", "verb", "sql")


BINLOG_TEXT = """CASE WHEN o_orderkey < 10 THEN 'DELIMITER /*!*/;' || chr(10) || '# at ' ELSE ' at ' END || o_orderkey * 100 || chr(10) || '#' || strftime(o_orderdate, '%y%m%d %-H:%M:%S')
  || ' server id 1  end_log_pos ' || o_orderkey || ' ' || chr(9) || CASE WHEN o_orderkey % 5 = 0 THEN 'Xid = ' || o_custkey || chr(10) || 'COMMIT/*!*/' ELSE 'Query' || chr(9) || 'thread_id=' || o_custkey % 90
  || chr(9) || 'exec_time=' || o_orderkey % 7 || chr(9) || 'error_code=0' || chr(10) || 'use db' || o_orderkey % 3 || '/*!*/;' || chr(10) || 'SET TIMESTAMP=' || o_orderkey + 1000 || '/*!*/;' || chr(10)
  || 'INSERT INTO t' || chr(10) || 'VALUES (' || o_orderkey || ')' || chr(10) || '/*!*/' END"""


@query("binlog_files", f"""
WITH p AS (SELECT o_orderkey, {_before(_bytes(BINLOG_TEXT) + " + 3", "o_orderkey % 10", "o_orderkey")} + CASE WHEN o_orderkey < 10 THEN 18 ELSE 0 END AS at FROM orders)
SELECT p.at AS pos, b.* EXCLUDE (pos) FROM ({BINLOG_SQL}) b JOIN p ON p.o_orderkey = b.pos""")
def binlog_files(t: Tables):
    """Decoded binary logs of ten servers; the delimiter set at the start of each holds to its end."""
    stored = _stored(t, _binlog_records(t).withColumnRenamed("file", "part"), "binlog", logs.RECORD_SEPARATOR)
    return _binlog_columns(logs.read_binlog_text(t.spark, stored))


@query("packet_files", f"""
WITH p AS (
  SELECT event_id, length('24-01-01 00:00:00.000000 IP 10.0.0..4 > 10.0.0.2.memcached: tcp' || user_id % 200 || event_id % 100) AS head, 80 + 2 * (9 + length(CAST(event_id AS VARCHAR))) AS digits, user_id FROM events
),
q AS (SELECT event_id, {_before("head + 10 + digits + (digits + 3) // 4 + 3", "user_id", "event_id")} AS at FROM p)
SELECT q.at AS pos, f.* EXCLUDE (pos) FROM ({PACKET_SQL}) f JOIN q ON q.event_id = f.pos""")
def packet_files(t: Tables):
    """Packet dumps of many clients, one folder each, read by path."""
    rows = _hex_records(t).join(t.events.select(F.col("event_id").alias("pos"), F.col("user_id").alias("part")), "pos")
    return _packet_columns(packets.read_packet_text(t.spark, _stored(t, rows, "packets", packets.PACKET_SEPARATOR)))
