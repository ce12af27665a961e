import datetime as dt

import pytest
from conftest import one
from pyspark.sql import functions as F

from fleetlens.functions import dates, numbers
from fleetlens.functions import privileges as pv


@pytest.mark.parametrize("spec,ref,expected", [
    ("-1q startof", "2010-03-01", "2009-10-01"), ("-1q startof", "2010-05-01", "2010-01-01"),
    ("-1q startof", "2010-10-01", "2010-07-01"), ("1q startof", "2010-05-01", "2010-07-01"),
    ("-1y", "2010-10-01", "2009-10-01"), ("-1y startof", "2010-10-01", "2009-01-01"),
    ("-1m startof", "2010-10-23", "2010-09-01"), ("1m startof", "2010-09-23", "2010-10-01"), ("1m.startof", "2010-09-23", "2010-10-01"),
])
def test_timespec(spark, spec, ref, expected):
    got = one(spark, ref, lambda c: dates.timespec(spec, F.col(c).cast("timestamp")).cast("string"))
    assert got == f"{expected} 00:00:00"


def test_timespec_epoch_and_errors(spark):
    assert one(spark, "2010-01-01", lambda c: dates.timespec("1295930000", F.col(c)).cast("string")) == "2011-01-25 04:33:20"
    with pytest.raises(ValueError):
        dates.timespec("tomorrow", F.lit("2010-01-01"))


@pytest.mark.parametrize("text,expected", [
    ("071015 21:43:52", "2007-10-15 21:43:52"), ("071015  1:43:52.5", "2007-10-15 01:43:52.500000"), ("not a date", "not a date"),
])
def test_parse_timestamp(spark, text, expected):
    assert one(spark, text, dates.parse_timestamp) == expected


@pytest.mark.parametrize("text,expected", [
    ("5", 1e9 - 5), ("2m", 1e9 - 120), ("3h", 1e9 - 10800), ("1d", 1e9 - 86400), ("071015", 1192406400.0),
    ("071015 21:43:52", 1192484632.0), ("2007-10-15", 1192406400.0), ("2007-10-15T21:43:52", 1192484632.0), ("junk", None),
])
def test_any_unix_timestamp(spark, text, expected):
    now = F.lit(dt.datetime(2001, 9, 9, 1, 46, 40)).cast("timestamp")
    assert one(spark, text, lambda c: dates.any_unix_timestamp(c, F.timestamp_seconds(F.lit(1_000_000_000)))) == expected
    del now


@pytest.mark.parametrize("secs,expected", [("0", "00:00"), ("59", "00:59"), ("3599", "59:59"), ("3600", "01:00:00"), ("90061", "1+01:01:01")])
def test_secs_to_time(spark, secs, expected):
    assert one(spark, secs, lambda c: dates.secs_to_time(F.col(c).cast("double"))) == expected


@pytest.mark.parametrize("pattern,expected", [("_%Y%m%d", "abcde_20100317"), ("_%Y_%V", "abcde_2010_11"), ("_%R", "abcde_00:00")])
def test_rotated_name(spark, pattern, expected):
    assert one(spark, "abcde", lambda c: dates.rotated_name(c, F.lit("2010-03-17"), pattern)) == expected


def test_age_from_name(spark):
    names = ["test_20101101", "test_20101104", "test_20101108", "test_20101116", "test_20101202", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("born", dates.age_from_name("n", "test_%Y%m%d"))
    at = F.lit("2010-11-04").cast("timestamp")
    assert [r.n[-4:] for r in df.filter(F.col("born") <= at).collect()] == ["1101", "1104"]
    assert [r.n[-4:] for r in df.filter(F.col("born") >= at).collect()] == ["1104", "1108", "1116", "1202"]


@pytest.mark.parametrize("text,expected", [("1y2M3w", 31536000 + 2 * 2592000 + 3 * 604800), ("5m", 300), ("", 0)])
def test_compound(spark, text, expected):
    assert one(spark, text, dates.compound_seconds) == expected


def test_clock_difference(spark):
    df = spark.sql("select timestamp'2024-01-01 23:59:59' a, timestamp'2024-01-01 00:00:01' b")
    assert df.select(dates.clock_difference("a", "b")).collect()[0][0] == 2.0


@pytest.mark.parametrize("value,expected", [("0", "0"), ("0.000001", "1us"), ("0.000999", "999us"), ("0.001", "1ms"), ("0.25", "250ms"), ("1", "1s"), ("90", "90s")])
def test_micro_t(spark, value, expected):
    assert one(spark, value, lambda c: numbers.micro_t(F.col(c).cast("double"))) == expected


@pytest.mark.parametrize("value,base,expected", [("12", 1024, "12"), ("1024", 1024, "1.00k"), ("1500", 1000, "1.50k"), ("1000000", 1000, "1.00M"), ("0.5", 1024, "0.50")])
def test_shorten_number(spark, value, base, expected):
    assert one(spark, value, lambda c: numbers.shorten_number(F.col(c).cast("double"), base=base)) == expected


def test_percentage_and_wide(spark):
    assert one(spark, "2", lambda c: numbers.percentage_of(F.col(c).cast("int"), F.lit(3))) == "66"
    assert one(spark, "2", lambda c: numbers.percentage_of(F.col(c).cast("int"), F.lit(0), 2)) == "200.00"
    assert str(one(spark, "861B144C", lambda c: numbers.hi_lo(F.col(c)))) == str(0x861B144C)
    assert str(one(spark, "125", lambda c: numbers.hi_lo(F.col(c), F.lit("3934414864")))) == str(125 * 2**32 + 3934414864)
    assert str(one(spark, "bigint(20) unsigned", numbers.integer_limit)) == str(2**64 - 1)
    assert str(one(spark, "int(11)", numbers.integer_limit)) == str(2**31 - 1)
    assert one(spark, "10.0.1.2", numbers.ip_to_long) == 167772418


def test_grants(spark):
    def grant(flags, level, bits=0, **cols):
        row = {"User": "u", "Host": "h", "Db": "d", "Table_name": "t", "Column_name": "c", **cols}
        df = spark.createDataFrame([(flags, pv.LEVEL_BITS[level] | bits, *row.values())], "f array<string>, permtype int, " + ", ".join(f"{k} string" for k in row))
        return df.select(pv.grant_text("f", "permtype")).collect()[0][0]

    assert grant(["Select_priv", "Grant_priv"], "table") == "GRANT SELECT ON `d`.`t` TO 'u'@'h' WITH GRANT OPTION"
    assert grant(list(pv.ALL_AT["global"]), "global", Host="") == "GRANT ALL PRIVILEGES ON *.* TO 'u'@'%'"
    assert grant([], "db") == "GRANT USAGE ON `d`.* TO 'u'@'h'"
    assert grant(["Select_priv", "Update_priv"], "column") == "GRANT SELECT (c), UPDATE (c) ON `d`.`t` TO 'u'@'h'"
    assert grant(["Repl_slave_priv", "Create_tmp_table_priv"], "global") == "GRANT REPLICATION SLAVE, CREATE TEMPORARY TABLES ON *.* TO 'u'@'h'"
    assert grant(["Select_priv"], "global", pv.DELETED) == "DROP USER 'u'@'h'"
    assert one(spark, "Select,Show view,Create tmp table", pv.flags_from_text) == ["Create_tmp_table_priv", "Select_priv", "Show_view_priv"]
