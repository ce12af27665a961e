import json
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.sources import logs, packets, status, tables
from fleetlens.sources.records import read_records

SLOW = """/usr/sbin/mysqld, Version: 5.0.38 (Debian). started with:
Tcp port: 3306  Unix socket: /var/run/mysqld/mysqld.sock
Time                 Id Command    Argument
# Time: 071015 21:43:52
# User@Host: root[root] @ localhost []
# Query_time: 2  Lock_time: 0  Rows_sent: 1  Rows_examined: 0
use test;
select sleep(2) from n;
# Time: 071015 21:45:10
# User@Host: bob[bob] @ web1 [10.1.2.3]
# Thread_id: 7  Schema: test
# Query_time: 2.5  Lock_time: 0.25  Rows_sent: 3  Rows_examined: 9
# QC_Hit: No  Full_scan: Yes
SET insert_id=5,timestamp=1192484710;
update t
set a = 'x;y'
where b = 1;
# User@Host: root[root] @ localhost []
# Query_time: 5  Lock_time: 0  Rows_sent: 0  Rows_examined: 0
use db3;
# administrator command: Ping;
# User@Host: root[root] @ localhost []
# Query_time: 1  Lock_time: 0  Rows_sent: 0  Rows_examined: 0
# administrator command: Quit;
/usr/sbin/mysqld, Version: 5.0.38 (Debian). started with:
Tcp port: 3306  Unix socket: /var/run/mysqld/mysqld.sock
Time                 Id Command    Argument
# Time: 071016  1:00:00
# User@Host: [SQL_SLAVE] @  []
# Query_time: 9  Lock_time: 0  Rows_sent: 1  Rows_examined: 0
select 1 /* page: home, user: ann */;
"""


@pytest.fixture
def write(tmp_path):
    def make(text, name="log.txt"):
        path = tmp_path / name
        path.write_bytes(text.encode())
        return str(path)

    return make


def test_slow_log(spark, write):
    e = logs.read_slow_log(spark, write(SLOW), r"/\*.*?\*/", r"(\w+): (\w+)").orderBy("pos", "part").collect()
    assert [r.arg for r in e] == [
        "select sleep(2) from n", "update t\nset a = 'x;y'\nwhere b = 1", "# administrator command: Ping",
        "# administrator command: Quit", "select 1 /* page: home, user: ann */"]
    assert [r.cmd for r in e] == ["Query", "Query", "Admin", "Admin", "Query"]
    assert [r.ts for r in e] == ["071015 21:43:52", "071015 21:45:10", None, None, "071016  1:00:00"]
    assert [r.user for r in e] == ["root", "bob", "root", "root", "[SQL_SLAVE]"]
    assert [r.db for r in e] == ["test", None, "db3", None, None]
    assert [r.Query_time for r in e] == [2.0, 2.5, 5.0, 1.0, 9.0]
    assert e[1].ip == "10.1.2.3" and e[1].host == "web1" and e[0].ip == ""
    assert e[1].attrs["insert_id"] == "5" and e[1].attrs["timestamp"] == "1192484710" and e[1].attrs["Full_scan"] == "Yes"
    assert e[4].attrs["page"] == "home" and e[4].attrs["user"] == "ann"
    assert e[0].pos == 0 and e[1].pos == SLOW.index(" Time: 071015 21:45:10") and e[0].bytes == 22


def test_slow_log_in_small_ranges(spark, write, monkeypatch):
    path = write(SLOW * 40)
    whole = logs.read_slow_log(spark, path).orderBy("pos", "part").collect()
    assert len(whole) == 200
    recs = read_records(spark, path, logs.RECORD_SEPARATOR, range_bytes=1000)
    assert recs.rdd.getNumPartitions() > 40
    # Positions are byte offsets, whatever the ranges.
    text = (SLOW * 40).encode()
    rows = recs.collect()
    assert len(rows) == 161 and all(text[r.pos : r.pos + r.size] == r.value.encode() for r in rows)
    parts = read_records(spark, path, logs.RECORD_SEPARATOR, unless=logs.ADMIN_MARK, range_bytes=333)
    assert logs.parse_slow_log(parts).orderBy("pos", "part").collect() == [r for r in logs.read_slow_log(spark, path).orderBy("pos", "part").collect()]


def test_slow_log_commands_after_statements(spark, write):
    text = "# User@Host: a[a] @ h []\n# Query_time: 1  Lock_time: 0  Rows_sent: 0  Rows_examined: 0\nselect 1;\n# administrator command: Quit;\n# administrator command: Ping;\n# User@Host: b[b] @ h []\n# Query_time: 2  Lock_time: 0  Rows_sent: 0  Rows_examined: 0\nselect 2;\n"
    e = logs.read_slow_log(spark, write(text)).orderBy("pos", "part").collect()
    assert [(r.arg, r.cmd, r.user, r.part) for r in e] == [
        ("select 1", "Query", "a", 0), ("# administrator command: Quit", "Admin", None, 1), ("# administrator command: Ping", "Admin", None, 2), ("select 2", "Query", "b", 0)]


def test_readers_do_not_shuffle_before_parsing(spark, write):
    df = logs.read_slow_log(spark, write(SLOW))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in packets.read_packet_text(spark, write("x", "p"))._jdf.queryExecution().executedPlan().toString()


def test_slow_log_searches_each_line_once(spark, write):
    df = logs.read_slow_log(spark, write(SLOW), r"/\*.*?\*/", r"(\w+): (\w+)")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The line of the account is found once; its three parts are looked for in that line alone.
    assert plan.count("_head#") > 0 and len(re.findall(r"regexp_extract\(_head#\d+, # User@Host", plan)) == 1 and "RLIKE(_head#" not in plan
    for line in (r"\(\?m\)\^# Time:", r"\(\?m\)\^use ", r"\(\?m\)\^\(# administrator", r"\(\?md\)\^# "):
        assert len(re.findall(rf"_head#\d+, {line}", plan)) == 1, line


def test_slow_log_attributes(spark, write):
    text = "# Time: 071015 21:43:52\n#  Time: 3\n# Thread_id: 8  Schema: db  Thread_id: 9\n# lower: 1 No: 2\n# QC_Hit: Yes  Last:   \nSET timestamp=1, a = 2 ,timestamp=3;\nselect 1 /* p: q, r: s, p: t */;\n"
    e = logs.read_slow_log(spark, write(text), r"/\*.*?\*/", r"(\w+): (\w+)").collect()
    assert [r.attrs for r in e] == [{"Time": "3", "Thread_id": "9", "Schema": "db", "QC_Hit": "Yes", "Last": "", "timestamp": "3", "a": "2 ", "p": "t", "r": "s"}]
    assert [(r.Thread_id, r.user, r.host, r.ip, r.Query_time) for r in e] == [(8.0, None, None, None, None)]


def test_slow_log_round_trip(spark, write, tmp_path):
    first = logs.read_slow_log(spark, write(SLOW))
    out = str(tmp_path / "again")
    cols = ["ts", "user", "host", "Thread_id", "Query_time", "Lock_time", "Rows_sent", "Rows_examined", "db"]
    plain = first.select(*cols, F.regexp_replace("arg", "^# ", "").alias("arg")).coalesce(1)
    logs.write_slow_log(plain, out)
    back = logs.read_slow_log(spark, out)
    key = lambda d: sorted((r.arg, r.user, r.Query_time, r.db or "") for r in d.collect())
    assert key(back) == key(first)


GENERAL = """/usr/sbin/mysqld, Version: 5.0 started with:
Tcp port: 3306
Time                 Id Command    Argument
051007 21:55:24\t     42 Connect     foo@localhost on db1
\t\t     42 Query       SELECT foo
                         FROM bar
\t\t     61 Connect     bar@web on
051007 21:55:25\t     61 Query       SELECT 2
\t\t     42 Query       SELECT 3
\t\t     61 Init DB     other
\t\t     61 Query       SELECT 4
\t\t     62 Connect     Access denied for user 'x'@'y'
\t\t     42 Quit
"""


def test_general_log(spark, write):
    text = GENERAL.replace("42 Quit\n", "42 Quit       \n")
    e = logs.read_general_log(spark, write(text)).orderBy("pos").collect()
    assert [(r.Thread_id, r.cmd, r.db) for r in e] == [
        ("42", "Admin", "db1"), ("42", "Query", "db1"), ("61", "Admin", None), ("61", "Query", None),
        ("42", "Query", "db1"), ("61", "Admin", "other"), ("61", "Query", "other"), ("62", "Admin", None), ("42", "Admin", None)]
    assert e[1].arg == "SELECT foo\n                         FROM bar"
    assert e[0].arg == "administrator command: Connect" and (e[0].user, e[0].host) == ("foo", "localhost")
    assert e[5].arg == "administrator command: Init DB" and e[7].arg.startswith("administrator command: Access denied")
    assert e[0].ts == "051007 21:55:24" and e[1].ts is None


BINLOG = """/*!40019 SET @@session.max_insert_delayed_threads=0*/;
DELIMITER /*!*/;
# at 4
#090722  7:21:41 server id 12345  end_log_pos 98 \tStart: binlog v 4, server v 5.0.82-log created 090722  7:21:41 at startup
ROLLBACK/*!*/;
# at 98
#090722  7:21:59 server id 12345  end_log_pos 175 \tQuery\tthread_id=3\texec_time=2\terror_code=0
use test1/*!*/;
SET TIMESTAMP=1248268919/*!*/;
SET @@session.pseudo_thread_id=3/*!*/;
create table t (
  a int
)
/*!*/;
# at 175
#090722  7:22:00 server id 12345  end_log_pos 202 \tXid = 26
COMMIT/*!*/;
DELIMITER ;
# End of log file
"""


def test_binlog(spark, write):
    e = logs.read_binlog_text(spark, write(BINLOG)).orderBy("pos").collect()
    q = [r for r in e if r.Thread_id][0]
    assert q.arg == "create table t (\n  a int\n)" and q.db == "test1" and q.Query_time == 2.0 and q.error_code == "0"
    assert q.offset == "98" and q.server_id == "12345" and q.end_log_pos == "175" and q.ts == "090722  7:21:59"
    assert q.attrs["timestamp"] == "1248268919" and q.attrs["@@session.pseudo_thread_id"] == "3"
    x = [r for r in e if r.Xid][0]
    assert x.Xid == "26" and x.arg == "COMMIT"
    assert [r.arg for r in e] == ["ROLLBACK", q.arg, "COMMIT"]


def test_raw_statements(spark, write):
    text = "use db1;\nSELECT 1;\n-- note\n;\nUPDATE t SET a = ';'\nWHERE b;\nuse db2;\nDELETE FROM x;\n"
    e = logs.read_raw_statements(spark, write(text)).orderBy("pos").collect()
    assert [(r.db, r.verb) for r in e] == [("db1", "SELECT"), ("db1", "UPDATE"), ("db2", "DELETE")]


def packet(ts, src, dst, seq, payload, flags="18"):
    body = payload.encode("latin-1").hex()
    total = f"{40 + len(payload):04x}"
    data = f"4500{total}000040004006000" + "0" + "7f0000017f000001" + "80e92bcb" + f"{seq:08x}" + "00000001" + "50" + flags + "ffff00000000" + body
    words = " ".join(data[i : i + 4] for i in range(0, len(data), 4))
    return f"{ts} IP {src} > {dst}: tcp {len(payload)}\n\t0x0000:  {words}\n"


def test_packets_and_key_value_pairs(spark, write):
    c, s = "10.0.0.1.4000", "10.0.0.2.memcached"
    d = "2024-01-01 10:00:0"
    text = "".join([
        packet(d + "0.000000", c, s, 1, "get my_key\r\n"), packet(d + "0.500000", s, c, 1, "VALUE my_key 0 8\r\nSome"),
        packet(d + "0.900000", s, c, 2, " val\r\nEND\r\n"),
        packet(d + "1.000000", c, s, 2, "get gone\r\n"), packet(d + "1.250000", s, c, 3, "END\r\n"),
        packet(d + "2.000000", c, s, 3, "set k 0 60 10\r\n12345"), packet(d + "2.100000", c, s, 4, "67890\r\n"), packet(d + "2.200000", s, c, 4, "STORED\r\n"),
        packet(d + "3.000000", c, s, 5, "get lost\r\n"), packet(d + "4.000000", c, s, 6, "incr n 1\r\n"), packet(d + "4.500000", s, c, 5, "8\r\n"),
    ])
    p = packets.read_packet_text(spark, write(text))
    first = p.orderBy("pos").first()
    assert (first.src_host, first.src_port, first.dst_port, first.data_len, first.complete) == ("10.0.0.1", "4000", "11211", 12, True)
    got = {(r.cmd, r.key): (r.res, r.val, round(r.Query_time, 3)) for r in packets.key_value_requests(p).collect()}
    assert got == {
        ("get", "my_key"): ("VALUE", "Some val", 0.9), ("get", "gone"): ("NOT_FOUND", "", 0.25), ("set", "k"): ("STORED", "1234567890", 0.2),
        ("get", "lost"): ("INTERRUPTED", "", 1.0), ("incr", "n"): ("", "8", 0.5)}


def test_http_pairs(spark, write):
    c, s = "10.0.0.1.4000", "10.0.0.2.http"
    d = "2024-01-01 10:00:0"
    text = "".join([
        packet(d + "0.000000", c, s, 1, "GET /a?b=1 HTTP/1.1\r\nHost: x.org\r\n\r\n"),
        packet(d + "0.200000", s, c, 2, "56789"), packet(d + "0.300000", s, c, 1, "HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n01234"),
        packet(d + "1.000000", c, s, 3, "HEAD /skip HTTP/1.1\r\n\r\n"), packet(d + "1.100000", s, c, 3, "HTTP/1.1 404 NO\r\n\r\n"),
    ])
    r = packets.http_requests(packets.read_packet_text(spark, write(text))).collect()
    assert [(x.arg, x.Status_code, x.bytes, round(x.Query_time, 3), round(x.Transmit_time, 3)) for x in r] == [("get x.org/a?b=1", "200", 10, 0.2, 0.1)]


def test_bad_packets_give_nulls(spark):
    schema = "ts string, pos long, seq long, src_host string, src_port string, dst_host string, dst_port string, data_len long, data string"
    client, server = ("10.0.0.1", "4000", "10.0.0.2", "11211"), ("10.0.0.2", "11211", "10.0.0.1", "4000")
    hexed = lambda t: t.encode().hex()
    rows = [
        ("2024-01-01 10:00:00", 1, 1, *client, 5, "abc0z"), ("2024-01-01 10:00:01", 2, 1, *server, 5, hexed("END\r\n")),
        ("2024-01-01 10:00:02", 3, 2, *client, 9, hexed("set k 0 0 many\r\nx\r\n")), ("2024-01-01 10:00:03", 4, 2, *server, 8, hexed("STORED\r\n")),
        ("no time", 5, 3, *client, 9, hexed("get a\r\n")), ("2024-01-01 10:00:05", 6, 3, *server, 9, "6"),
    ]
    got = packets.key_value_requests(spark.createDataFrame(rows, schema), order=("pos",), block=F.lit(0)).orderBy("pos").collect()
    assert [(r.cmd, r.res, r.bytes, r.Query_time) for r in got] == [(None, "NOT_FOUND", 0, 1.0), ("set", "STORED", 0, 1.0), ("get", "\x06", 0, None)]


def test_packets_cut_short_give_no_text(spark, write):
    c, s, d = "10.0.0.1.4000", "10.0.0.2.memcached", "2024-01-01 10:00:0"
    whole, short = packet(d + "0.500000", s, c, 1, "VALUE k 0 8\r\nSome val\r\nEND\r\n"), packet(d + "2.500000", s, c, 2, "VALUE k 0 8\r\nSome val\r\nEND\r\n")
    text = packet(d + "0.000000", c, s, 1, "get k\r\n") + whole + packet(d + "2.000000", c, s, 2, "get k\r\n") + short[:-16] + "\n"
    p = packets.read_packet_text(spark, write(text))
    assert [r.complete for r in p.orderBy("pos").collect()] == [True, True, True, False]
    assert [(r.res, r.val) for r in packets.key_value_requests(p).orderBy("pos").collect()] == [("VALUE", "Some val"), (None, "")]


STATUS = """Mutex spin waits 0, rounds 265, OS waits 88
RW-shared spins 2442, OS waits 1219; RW-excl spins 4, OS waits 3
Trx id counter 861B144C
Purge done for trx's n:o < 861B135D undo n:o < 0
History list length 132
---TRANSACTION 0, not started, process no 1
---TRANSACTION 5, ACTIVE 3 sec, process no 2
LOCK WAIT 2 lock struct(s), heap size 368
Log sequence number 125 3934414864
Log flushed up to   125 3934414800
Last checkpoint at  125 3934293461
Buffer pool size        1769471
Buffer pool size, bytes 28991012864
Pages read 15240822, created 1770238, written 21705836
  Page hash           11688584
1 read views open inside InnoDB
"""


def test_engine_status(spark):
    df = spark.createDataFrame([("a", STATUS)], "server string, text string")
    got = {r.metric: int(r.value) for r in status.status_metrics(df, ["server"]).collect()}
    assert got["spin_waits"] == 2446 and got["os_waits"] == 88 + 1219 + 3 and got["spin_rounds"] == 265
    assert got["innodb_transactions"] == 0x861B144C and got["unpurged_txns"] == 0x861B144C - 0x861B135D and got["history_list"] == 132
    assert got["current_transactions"] == 2 and got["active_transactions"] == 1 and got["locked_transactions"] == 1
    assert got["innodb_lsn"] == 125 * 2**32 + 3934414864 and got["unflushed_log"] == 64 and got["uncheckpointed_bytes"] == 121403
    assert got["pool_size"] == 1769471 and got["pages_written"] == 21705836 and got["page_hash_memory"] == 11688584 and got["read_views"] == 1


def test_delimited_and_documents(spark, write):
    path = write("1\tnull\tPOINT(1 2)\n2\tx\tnull\n")
    rows = tables.read_delimited(spark, path, "id int, name string, wkt string").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, "POINT(1 2)"), (2, "x", None)]
    doc = {"servers": {"s1": {"active": "true", "version": "5.0", "readfor": ["c1"], "writefor": []}}, "clusters": {"c1": {"active": "true", "schemas": ["d"], "primary": "s1", "failover": None, "servers": ["s1"]}}}
    servers, clusters = tables.read_documents(spark, write(json.dumps(doc, indent=1), "d.json"))
    assert servers.collect()[0].readfor == ["c1"] and clusters.collect()[0].primary == "s1"


def test_tables_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b", None), (2, "c\\d", "x")], "id int, t string, n string")
    tables.archive_rows(df, "tbl", str(tmp_path / "arch"), where="id = 1")
    assert [r.value for r in spark.read.text(str(tmp_path / "arch")).collect()] == ["INSERT INTO `tbl` (`id`,`t`,`n`) VALUES (1,'a\\'b',NULL);"]
    path = str(tmp_path / "t")
    tables.append_rows(df, path)
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == [1, 2]


def test_packets_of_many_small_dumps(spark, tmp_path):
    dump = "2008-01-01 00:00:0%d.1 IP 10.0.0.%d.4000 > 10.0.0.2.memcached: tcp 4\n\t0x0000:  4500 002c 0000 0000 4006 0000 0a00 0001\n\t0x0010:  0a00 0002 c000 2bcb 0000 0001 0000 0002\n\t0x0020:  5018 ffff 0000 0000 6162 6364\n"
    for i in range(200):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "records").write_text(dump % (1, i) + dump % (2, i))
    p = packets.read_packet_text(spark, f"{tmp_path}/*")
    assert p.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    rows = sorted((r.ts, r.pos, r.src_host, r.src_port, r.dst_host, r.dst_port, r.data, r.complete) for r in p.collect())
    size = lambda i: len(dump % (1, i)) + 2
    assert rows == sorted((f"2008-01-01 00:00:0{n}.1", 0 if n == 1 else size(i), f"10.0.0.{i}", "4000", "10.0.0.2", "11211", "61626364", True) for i in range(200) for n in (1, 2))
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract\(_v#\d+, ", plan)) == 1


def test_raw_statements_of_many_small_files(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "records").write_text(f"DELETE FROM a;\nUSE `db{i}`;\nDELETE FROM t{i};\n" if i % 3 else f"SELECT {i};\n")
    s = logs.read_raw_statements(spark, f"{tmp_path}/*")
    # The database in use never goes on in another file of the same task.
    wanted = [(f"part={i}", p, d, q) for i in range(200) for p, d, q in ([(0, None, "DELETE FROM a"), (25 + len(str(i)), f"db{i}", f"DELETE FROM t{i}")] if i % 3 else [(0, None, f"SELECT {i}")])]
    assert sorted((r.file.split("/")[-2], r.pos, r.db, r.sql) for r in s.collect()) == sorted(wanted)
    found = read_records(spark, f"{tmp_path}/*", logs.STATEMENT_SEPARATOR)
    assert found.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
