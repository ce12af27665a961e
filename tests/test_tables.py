"""Versions, privileges, partitions, checks, masks: golden rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import privileges as pv
from fleetlens.operators import catalog as cat
from fleetlens.operators import checks, consistency, filters, masking, reports
from fleetlens.operators import lifecycle as lc
from fleetlens.operators import topology as topo

D = dt.date


def test_definition_status(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "a", None), (5, "a", "y"), (6, "b", "q"), (7, None, None)]
    df = spark.createDataFrame(rows, "id long, table_name string, create_syntax string").withColumns({"server": F.lit("s"), "database_name": F.when(F.col("table_name").isNotNull(), "d")})
    out = cat.version_status(df, ["create_syntax"], ["create_syntax"])
    assert [r.status for r in out.orderBy("id").collect()] == ["new", "unchanged", "changed", "deleted", "new", "new", "unreachable"]


def test_privilege_changes(spark):
    schema = "server string, Host string, Db string, User string, Table_name string, flags array<string>"
    a = spark.createDataFrame([("s", "%", "d", "u", "t", ["Select_priv"])], schema)
    b = spark.createDataFrame([("s", "%", "d", "u", "t", ["Select_priv", "Insert_priv"])], schema)
    rows = lambda df: cat.privilege_rows({"global": df, "table": df})
    none = rows(a).limit(0)
    assert sorted(r.change for r in cat.privilege_changes(rows(a), none).collect()) == ["new", "new"]
    assert cat.privilege_changes(rows(a), rows(a)).count() == 0
    changed = cat.privilege_changes(rows(b), rows(a)).collect()
    assert {r.change for r in changed} == {"changed"} and changed[0].flags == ["Insert_priv", "Select_priv"]
    assert {r.change for r in cat.privilege_changes(none, rows(a)).collect()} == {"deleted"}
    assert {r.permtype for r in rows(a).collect()} == {pv.LEVEL_BITS["global"], pv.LEVEL_BITS["table"]}


def parts(spark, bounds, start=0):
    return spark.createDataFrame([(f"p{start + i}", b) for i, b in enumerate(bounds)], "name string, bound date")


def plan(df):
    return [(r.name, r.bound) for r in df.orderBy(F.regexp_extract("name", r"(\d+)", 1).cast("int")).collect()]


def test_add_partitions(spark):
    days = parts(spark, [D(2011, 1, 15), D(2011, 1, 16), D(2011, 1, 17)])
    assert plan(lc.plan_partitions(days, "2011-01-20", "1 day")) == [("p3", D(2011, 1, 18)), ("p4", D(2011, 1, 19)), ("p5", D(2011, 1, 20))]
    weeks = parts(spark, [D(2011, 1, 14), D(2011, 1, 21), D(2011, 1, 28)])
    assert plan(lc.plan_partitions(weeks, "2011-02-18", "7 days")) == [("p3", D(2011, 2, 4)), ("p4", D(2011, 2, 11)), ("p5", D(2011, 2, 18))]
    six = parts(spark, [D(2011, 1, 15 + i) for i in range(6)])
    assert plan(lc.plan_partitions(six, "2011-01-28", "1 day", limit=3)) == [("p6", D(2011, 1, 21)), ("p7", D(2011, 1, 22)), ("p8", D(2011, 1, 23))]
    assert plan(lc.plan_partitions(six, "2011-01-10", "1 day")) == []


def test_split_maxvalue(spark):
    weeks = parts(spark, [D(2011, 1, 14), D(2011, 1, 21), D(2011, 1, 28)]).unionByName(spark.createDataFrame([("p3", None)], "name string, bound date"))
    busy = spark.createDataFrame([(2,)], "cnt long")
    with pytest.raises(Exception, match="MAXVALUE"):
        lc.plan_partitions(weeks, "2011-02-04", "7 days", maxvalue_rows=busy).collect()
    assert plan(lc.plan_partitions(weeks, "2011-02-04", "7 days", maxvalue_rows=busy, force=True)) == [("p3", D(2011, 2, 4)), ("p4", None)]


def test_drop_and_archive_partitions(spark):
    nine = parts(spark, [D(2011, 1, 15 + i) for i in range(9)])
    gone = lc.partitions_before(nine, D(2011, 1, 18))
    assert sorted(r.bound.day for r in gone.collect()) == [15, 16, 17]
    rest = nine.join(gone, "name", "left_anti")
    assert sorted(r.bound.day for r in lc.partitions_before(rest, D(2011, 1, 23)).collect()) == [18, 19, 20, 21, 22]


def test_walk(spark):
    idx = [("id", "primary", "int"), ("uniq_xref", "unique", "int"), ("uniq_ts", "unique", "timestamp"), ("goober", "key", "int"), ("xref_ts", "key", "timestamp"), ("name", "key", "varchar")]
    df = spark.createDataFrame([("t", *i) for i in reversed(idx)], "table_name string, key_name string, key_type string, column_type string")
    assert [r.key_name for r in consistency.walk_order(df).orderBy("position").collect()] == [i[0] for i in idx[:-1]]
    for ids, size in (([*range(1, 11)], 2), ([*range(1, 55)], 50), ([*range(1, 55), 100], 50)):
        out = consistency.batches(spark.createDataFrame([(i,) for i in ids], "id long"), "id", size)
        assert sorted(r.id for r in out.collect()) == ids
        assert out.groupBy("batch").count().agg(F.max("count")).first()[0] <= size


def test_checksums(spark):
    rows = [("d", "t", 1, 5, 77, 5, 77), ("d", "t", 2, 5, 77, 6, 77), ("d", "t", 3, 5, 77, 5, 78), ("d", "t", 4, 5, None, 5, None), ("d", "t", 5, 5, 77, None, None)]
    df = spark.createDataFrame(rows, "db string, tbl string, chunk int, this_cnt long, this_crc long, master_cnt long, master_crc long")
    got = {r.chunk: (r.cnt_diff, r.crc_diff) for r in consistency.checksum_differences(df).collect()}
    assert got == {2: (-1, 0), 3: (0, 1), 5: (0, 1)}
    t = spark.range(1000).withColumn("x", F.col("id") * 3)
    a = consistency.chunk_checksums(t, "id", ["id", "x"], 100, low=0)
    b = consistency.chunk_checksums(t.repartition(13), "id", ["id", "x"], 100, low=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 10


def test_catalog_predicates(spark):
    rows = [("table_20", "InnoDB", "Compact", 100, 0), ("table_19", "MyISAM", "Fixed", 100, 0), ("bobtable_20", "InnoDB", "Compact", 4096, 4096)]
    df = spark.createDataFrame(rows, "Name string, Engine string, Row_format string, Data_length long, Index_length long")
    names = lambda **k: sorted(r.Name for r in filters.find_tables(df, **k).collect())
    assert names(engine="innodb", name="^table") == ["table_20"]
    assert names(greater_than=1024, smaller_than=16384) == ["bobtable_20"]
    assert names(row_format="fixed") == ["table_19"]


def topology(spark, servers, clusters):
    s = spark.createDataFrame(servers, "server string, active string, version string, readfor array<string>, writefor array<string>")
    c = spark.createDataFrame(clusters, "cluster string, active string, schemas array<string>, primary string, failover string, servers array<string>")
    return sorted((r.rule, r.server, r.cluster) for r in topo.referential_violations(s, c).collect())


def test_topology_rules(spark):
    good_s = [("a", "true", "5", ["c1"], ["c1"]), ("b", "true", "5", ["c1"], [])]
    good_c = [("c1", "true", ["d"], "a", "b", ["a", "b"])]
    assert topology(spark, good_s, good_c) == []
    assert topology(spark, good_s, [("c1", "true", ["d"], "a", "b", ["a"])]) == [("ClusterMismatch", "b", "c1")]
    assert topology(spark, good_s, [("c1", "true", ["d"], "b", None, ["a", "b"])]) == [("PrimaryMismatch", "b", "c1")]
    assert topology(spark, [("a", "true", "5", ["c1"], ["c1"]), ("b", "true", "5", [], [])], good_c) == [("FailoverMismatch", "b", "c1")]
    assert ("UnknownCluster", "b", "c9") in topology(spark, [good_s[0], ("b", "true", "5", ["c1", "c9"], [])], good_c)
    assert topology(spark, [("a", "true", None, ["c1"], ["c1"]), good_s[1]], good_c) == [("MissingKey:version", "a", None)]
    assert topology(spark, good_s, [("c1", "true", ["d"], None, None, ["a", "b"])]) == []


def test_backup_chain(spark):
    rows = [("f", 0, None), ("i1", 1, "f"), ("i2", 1, "i1"), ("x1", 1, "gone"), ("x2", 1, "x1")] + [(f"n{i}", 1, f"n{i-1}" if i else "f") for i in range(20)]
    df = spark.createDataFrame(rows, "backup_directory string, backup_level int, last_backup string")
    got = {r.backup: (r.full_backup, r.steps, r.complete) for r in topo.backup_chain(df).collect()}
    assert got["i2"] == ("f", 2, True) and got["f"] == ("f", 0, True) and got["x2"] == (None, None, False) and got["n19"] == ("f", 20, True)


def test_checks(spark):
    lag = spark.createDataFrame([(x,) for x in (-5.0, 0.5, 5.0, 70.0, 700.0)], "lag double")
    assert [r.status for r in checks.lag_band(lag, "lag", 1, 60, 0, 600).collect()] == ["CRITICAL", "WARNING", "OK", "WARNING", "CRITICAL"]
    words = spark.createDataFrame([("x", "done"), ("x", "busy")], "k string, v string")
    assert checks.range_check(words, ["k"], "v", "done", "failed").collect()[0].status == "WARNING"
    assert checks.range_check(words, ["k"], "v", "done", "failed", "all").collect()[0].status == "OK"
    roles = spark.createDataFrame([(True, True), (False, True), (True, False)], "read_only boolean, is_master boolean")
    assert [r.status for r in checks.role_check(roles).collect()] == ["CRITICAL", "OK", "OK"]


def test_masks(spark):
    df = spark.createDataFrame([(1, "John Smith", "555-123-4567"), (2, "Cher", "(555) 123-4567"), (3, None, "+1 555 123-4567")], "id long, name string, phone string")
    spec = {"name": masking.MaskSpec(masking.PATTERNS["name"], [("A", "B")]), "phone": masking.MaskSpec(masking.PATTERNS["phonenumber"], [("000-0000",)])}
    got = masking.mask(df, spec, ["id"]).orderBy("id").collect()
    assert [(r.name, r.phone) for r in got] == [("A B", "555-000-0000"), ("Cher", "(555) 000-0000"), (None, "+1 555 000-0000")]
    with pytest.raises(Exception, match="unable to match"):
        masking.mask(df, {"name": masking.MaskSpec(masking.PATTERNS["name"], [("A", "B")], fail_unmatched=True)}, ["id"]).collect()
    mail = spark.range(500).withColumn("m", F.concat(F.lit("u"), "id", F.lit("@x.org")))
    one = masking.mask(mail, {"m": masking.MaskSpec(masking.PATTERNS["email"])}, ["id"], seed=3)
    two = masking.mask(mail.repartition(9), {"m": masking.MaskSpec(masking.PATTERNS["email"])}, ["id"], seed=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    for wanted, letters in ((1, 2), (2, 2), (12, 12), (100, 100)):
        uniq = masking.mask_unique(mail, "m", ["id"], length=wanted)
        assert uniq.select("m").distinct().count() == 500 and {len(r.m) for r in uniq.collect()} == {letters}
    long = spark.range(20).withColumn("m", F.concat(F.repeat(F.lit("u"), 300), F.lit("@x.org")))
    assert max(len(r.m) for r in masking.mask(long, {"m": masking.MaskSpec(masking.PATTERNS["email"])}, ["id"], seed=3).collect()) > 100
    spark.udf.register("shout", lambda x: x.upper())
    assert masking.mask(df.filter("id = 2"), {"name": masking.MaskSpec(routine="shout")}, ["id"]).first().name == "CHER"


def test_prune_and_merge(spark):
    parents, kids = spark.range(100).withColumnRenamed("id", "pid"), spark.range(300).select((F.col("id") % 105).alias("ref"), "id")
    kept, (left,) = lc.prune(parents, [(kids, "ref")], "pid", 10)
    assert kept.count() == 10 and left.filter("ref between 10 and 99").count() == 0 and left.filter("ref >= 100").count() == kids.filter("ref >= 100").count()
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, lc.merge_sources([a, b], ["k"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="duplicate key"):
        lc.merge_sources([a, b], ["k"], "die").collect()


def test_merge_review_defaults(spark):
    cols = "checksum long, fingerprint string, sample string, first_seen timestamp, last_seen timestamp"
    review = spark.createDataFrame([], cols + ", reviewed_by string, reviewed_on timestamp, comments string")
    seen = spark.createDataFrame([(1, "f", "s", None, None)], cols)
    row = lc.merge_review(review, seen, "2024-01-01").collect()[0]
    assert row.first_seen == row.last_seen == dt.datetime(2024, 1, 1)


def test_size_rollup_zero_is_null(spark):
    df = spark.createDataFrame([("s", "d", "t", 0, 1024), ("s", None, None, None, None)], "server string, database_name string, table_name string, data_length long, index_length long")
    assert {(r.database_name, r.data_length, r.index_length) for r in cat.sizes(df).collect()} == {(None, None, 1024), ("d", None, 1024)}


def test_consolidation_unknown_buckets(spark):
    t0 = dt.datetime(2024, 1, 1)
    pts = [("a", t0 + dt.timedelta(hours=h), float(h)) for h in (0, 1, 2, 4, 5)]
    df = spark.createDataFrame(pts, "s string, ts timestamp, v double")
    out = cat.consolidate(df, ["s"], "ts", "v", 3600, "2024-01-01 08:00:00", ((1, 86400), (4, 86400), (1, 7200)))
    got = {(r.factor, r.bucket.hour): (r.average, r.max) for r in out.filter("factor = 4").collect()}
    assert got == {(4, 0): (1.0, 2.0), (4, 4): (None, None)}


def test_latency_and_merge(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, value double")
    b = spark.createDataFrame([("y", 9.0)], "name string, value double")
    assert sorted(map(tuple, reports.merge_metrics(a, b, ["name"]).collect())) == [("x", 1.0), ("y", 9.0)]


def test_rows_are_on_one_side_exactly(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5), (4, 5), (5, 7)], "id int, at int")
    gone, kept = lc.split_rows(rows, "id > 0", 3, ["at"])
    assert sorted(r.id for r in gone.collect()) == [1, 2, 3] and sorted(r.id for r in kept.collect()) == [4, 4, 5]


def test_null_and_repeated_keys(spark):
    schema = "k int, v string"
    a, b = spark.createDataFrame([(None, "a"), (None, "b"), (1, "z"), (1, "y")], schema), spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], schema)
    assert sorted(map(str, lc.merge_sources([a, b], ["k"]).collect())) == sorted(f"Row(k={k}, v='{v}')" for k, v in ((None, "a"), (None, "b"), (None, "d"), (1, "y"), (2, "e")))
    have, new = spark.createDataFrame([(None, "a"), (1, "b")], schema), spark.createDataFrame([(None, "x"), (1, "y"), (3, "q"), (3, "p")], schema)
    assert {(r.k, r.v) for r in lc.insert_if_absent(have, new, ["k"]).collect()} == {(None, "a"), (1, "b"), (3, "p")}
    assert {(r.k, r.v) for r in lc.replace_history(have, new.filter("v <> 'p'"), ["k"]).collect()} == {(None, "x"), (1, "y"), (3, "q")}
    parents, kids = spark.createDataFrame([(None,), (1,), (2,)], "id int"), spark.createDataFrame([(1,), (2,), (9,), (None,)], "ref int")
    for keep, left, children in ((0, {None}, {9, None}), (1, {None, 1}, {1, 9, None}), (5, {None, 1, 2}, {1, 2, 9, None})):
        kept, (out,) = lc.prune(parents, [(kids, "ref")], "id", keep)
        assert {r.id for r in kept.collect()} == left and {r.ref for r in out.collect()} == children


def test_newest_mark_is_taken_once(spark):
    schema = "checksum int, reviewed_by string, reviewed_on timestamp, comments string"
    day = lambda d: dt.datetime(2024, 1, d)
    review = spark.createDataFrame([(1, "ann", day(5), None), (2, "ann", day(5), None), (3, None, None, None)], schema)
    marks = spark.createDataFrame([(1, "bob", day(6), "b"), (1, "cy", day(7), "c"), (2, "bob", day(2), "old"), (3, "dee", None, None)], schema)
    assert {r.checksum: r.reviewed_by for r in lc.apply_review_marks(review, marks).collect()} == {1: "cy", 2: "ann", 3: "dee"}


def test_many_bounds_and_refusals(spark):
    bounds = spark.range(9000).select((F.col("id") * 10 + 10).alias("bound"), F.concat(F.lit("p"), "id").alias("name"))
    rows = spark.createDataFrame([(None,), (-5,), (9,), (10,), (89_999,), (90_000,)], "v long")
    got = {r.v: r.partition for r in lc.assign_partition(rows, bounds, "v").collect()}
    assert got == {None: "p0", -5: "p0", 9: "p0", 10: "p1", 89_999: "p8999", 90_000: None}
    dated = spark.createDataFrame([("p1", "2024-01-01"), ("odd", "2024-02-01")], "name string, bound string").withColumn("bound", F.col("bound").cast("date"))
    with pytest.raises(Exception, match="does not fit"):
        lc.plan_partitions(dated, "2024-06-01", "1 month").collect()
    with pytest.raises(Exception, match="no partition with a bound"):
        lc.plan_partitions(dated.withColumn("bound", F.lit(None).cast("date")), "2024-06-01", "1 month").collect()


def test_backups_in_a_circle(spark):
    rows = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("f", None, 0)] + [(f"i{i}", f"i{i - 1}" if i else "f", 1) for i in range(50)]
    got = {r.backup: (r.full_backup, r.steps) for r in topo.backup_chain(spark.createDataFrame(rows, "backup_directory string, last_backup string, backup_level int")).collect()}
    assert got["a"] == got["b"] == got["c"] == (None, None) and got["i49"] == ("f", 50) and len(got) == 54
