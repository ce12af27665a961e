import pytest
from conftest import one
from pyspark.sql import functions as F

from fleetlens.functions import text

FINGERPRINTS = [
    ("SELECT /*!40001 SQL_NO_CACHE */ * FROM `t`", "mysqldump"),
    ("REPLACE /*db.tbl:1/2*/ INTO x", "maatkit"),
    ("# administrator command: Ping", "# administrator command: Ping"),
    ("  CALL Foo.Bar(1, 2)", "call foo.bar"),
    ("INSERT INTO t (a) VALUES (1), (2), (3)", "insert into t (a) values(?+)"),
    ("insert ignore into t values ('a', 2),('b', 3)", "insert ignore into t values(?+)"),
    ("USE foo", "use ?"),
    ("select * from t -- trailing\nwhere a = 1", "select * from t where a = ?"),
    ("select /* c */ a /*!40000 keep */ from t", "select a /*!? keep */ from t"),
    ('select "a\\"b", \'c\' from t', "select ?, ? from t"),
    ("select a from t where b = -1.5e10 and c = 0x1f", "select a from t where b = ? and c = ?"),
    ("SELECT a\n\t FROM   t\n", "select a from t"),
    ("select a from t where b is NULL", "select a from t where b is ?"),
    ("select a from t where b in (1, 2, 3) and c in ('x')", "select a from t where b in(?+) and c in(?+)"),
    ("select 1 union select 2 union select 4", "select ? /*repeat union*/"),
    ("select a from t where x=1 union all select a from t where x=2", "select a from t where x=? /*repeat union all*/"),
    ("select a from t limit 5", "select a from t limit ?"),
    ("select a from t limit 5, 10", "select a from t limit ?"),
    ("select a from t limit 5 offset 10", "select a from t limit ?"),
]


@pytest.mark.parametrize("sql,expected", FINGERPRINTS)
def test_fingerprint(spark, sql, expected):
    assert one(spark, sql, text.fingerprint) == expected


def test_fingerprint_is_idempotent(spark):
    df = spark.createDataFrame([(s,) for s, _ in FINGERPRINTS], "x string")
    once = df.select(text.fingerprint("x").alias("f")).filter("f not like '%repeat%' and f not like '%/*!%'")
    assert once.filter(text.fingerprint("f") != F.col("f")).count() == 0


def test_long_value_lists_do_not_overflow(spark):
    sql = "select * from t where a in (" + ", ".join(["1"] * 50000) + ") or (a) in " + ", ".join(["(1)"] * 20000)
    assert one(spark, sql, text.fingerprint) == "select * from t where a in(?+) or (a) in(?+)"


@pytest.mark.parametrize("sql,expected", [
    ("SELECT * FROM t WHERE a IN (1, 2) AND b = 'x'", "select * from t where a IN (N2) and b = 'S'"),
    ("select 1; select 2", "select N;\nselect N"),
    ("update t set a = '' where b in ('p', 'q', 'r')", "update t set a = 'S' where b IN (S3)"),
])
def test_abstract(spark, sql, expected):
    assert one(spark, sql, text.abstract_stmt) == expected


@pytest.mark.parametrize("sql,expected", [
    ("SELECT a FROM b JOIN c ON x = y", "SELECT b c"),
    ("INSERT INTO t1 SELECT a FROM `db`.`t2`", "INSERT SELECT t? db.t?"),
    ("select a from t1 union select b from t2 union select c from t3", "SELECT UNION t?"),
    ("SHOW CREATE TABLE foo", "SHOW CREATE TABLE"),
    ("SHOW DATABASES", "SHOW DATABASES"),
    ("DROP TABLE IF EXISTS foo", "DROP TABLE IF"),
    ("CREATE DATABASE foo", "CREATE DATABASE foo"),
    ("UNLOCK TABLES", "UNLOCK"),
    ("XA COMMIT 'x'", "XA_COMMIT"),
    ("call foo(1)", "CALL foo"),
    ("# administrator command: Quit", "ADMIN"),
    ("LOCK TABLES foo READ, bar WRITE", "LOCK foo bar"),
    ("BEGIN", "BEGIN"),
])
def test_distill(spark, sql, expected):
    assert one(spark, sql, text.distill) == expected


@pytest.mark.parametrize("sql,expected", [
    ("SELECT * FROM a, b AS c, d.e WHERE 1", ["a", "b", "d.e"]),
    ("UPDATE LOW_PRIORITY t SET x = 'FROM z'", ["t"]),
    ("INSERT INTO x (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2", ["x"]),
    ("CREATE TABLE foo (a int)", ["foo"]),
    ("ALTER TABLE db.foo ADD x int", ["db.foo"]),
    ("CREATE DATABASE foo", []),
    ("CREATE TABLE x AS SELECT * FROM y JOIN z", ["y", "z"]),
])
def test_get_tables(spark, sql, expected):
    assert one(spark, sql, text.get_tables) == expected


def test_split_keeps_duplicate_key(spark):
    sql = "INSERT INTO t VALUES (1) ON DUPLICATE KEY UPDATE a = 1"
    assert one(spark, sql, text.split_statements) == [sql]
    assert one(spark, "INSERT INTO a SELECT b FROM c", text.split_statements) == ["INSERT INTO a ", "SELECT b FROM c"]
    assert one(spark, "SELECT REPLACE(a, 'x', 'y') FROM t", text.split_statements) == ["SELECT REPLACE(a, 'x', 'y') FROM t"]


def test_shorten(spark):
    ids = ",".join(str(i) for i in range(25))
    out = one(spark, f"SELECT a FROM t WHERE id IN ({ids}) AND b IN (1,2)", lambda c: text.shorten(c, 20))
    kept = ",".join(str(i) for i in range(20))
    assert out == f"SELECT a FROM t WHERE id IN ({kept}/*... omitted 5 items ...*/) AND b IN (1,2)"
    short = "SELECT a FROM t WHERE id IN (1,2)"
    assert one(spark, short, lambda c: text.shorten(c, 10)) == short
    assert one(spark, "x IN (SELECT 1)" + " " * 99, lambda c: text.shorten(c, 10)).startswith("x IN (SELECT 1)")


def test_small_functions(spark):
    assert one(spark, "get foo_123", text.key_fingerprint) == "get foo_?"
    assert one(spark, "get /a/b?x=1;y", lambda c: text.distill_generic(c, True)) == "GET /a/b"
    assert one(spark, "nothing", text.distill_generic) == ""
    assert one(spark, "hello", text.class_id) == "B9719D911017C592"
    assert one(spark, "hello", lambda c: text.class_checksum(c).cast("string")) == str(0xB9719D911017C592)
    assert one(spark, "ENGINE=InnoDB AUTO_INCREMENT=79 DEFAULT", text.strip_auto_increment) == "ENGINE=InnoDB DEFAULT"
    found = one(spark, "SELECT 1 /* file: a, line: 2, file: b */", lambda c: text.embedded_attributes(c, r"/\*.*\*/", r"(\w+): (\w+)"))
    assert found == {"file": "b", "line": "2"}
