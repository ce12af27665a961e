import pytest
from pyspark.sql import functions as F

from fleetlens.operators import digest as dg
from fleetlens.operators import filters


def test_verbs(spark):
    df = spark.createDataFrame([("select",), ("insert",), ("update",)], "verb string")
    names = lambda spec: [r.verb for r in filters.by_verb(df, spec).collect()]
    assert names("-*,+SELECT") == ["select"]
    assert names("-INSERT") == ["select", "update"]
    assert names("") == ["select", "insert", "update"]


def test_latching_filters(spark):
    rows = [("a", 1, 5), ("a", 2, 20), ("a", 3, None), ("a", 4, 1), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "file string, pos long, ts long")
    assert sorted((r.file, r.pos) for r in filters.since(df, "ts", 10).collect()) == [("a", 2), ("a", 3), ("a", 4)]
    assert sorted((r.file, r.pos) for r in filters.until(df, "ts", 10).collect()) == [("a", 1), ("b", 1)]


def test_aliases_and_history(spark):
    df = spark.createDataFrame([(1, None, "y")], "id int, a string, b string")
    assert filters.alias_attributes(df, "a|b|c").collect()[0].asDict() == {"id": 1, "a": "y"}
    with pytest.raises(ValueError):
        filters.by_history(df, "id", "<>", 1)


def test_order_attribute():
    assert dg.order_attribute(["Query_time", "bytes"], "bytes") == "bytes"
    assert dg.order_attribute(["Query_time"], "bytes") == "Query_time"
    assert dg.order_attribute(["x"], "bytes") == "cnt"


def test_types_look_at_every_value(spark):
    df = spark.createDataFrame([("1", "Yes", None), ("2.5e3", "No", None), ("x", "Yes", None)], "a string, b string, c string")
    got = {r.attribute: r.type for r in dg.infer_types(df, ["a", "b", "c"]).collect()}
    assert got == {"a": "string", "b": "bool", "c": None}
    assert dg.infer_types(df.filter(F.col("a") != "x"), ["a"]).collect()[0].type == "num"
