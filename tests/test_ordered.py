"""Block-wise windows against plain ones, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions import histogram as hist
from fleetlens.operators import digest as dg
from fleetlens.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "c"])
        data.append((key, i, rnd.choice([None, 1.0, 2.0, 3.5]), rnd.choice("xyz")))
    return spark.createDataFrame(data, "k string, pos long, v double, state string").repartition(7).cache()


def same(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, a.select(cols).collect()), key=key) == sorted(map(tuple, b.select(cols).collect()), key=key)


@pytest.mark.parametrize("size", [1, 13, 400, 10**6])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_previous_following_carry_sum(rows, size, keys):
    w = Window.partitionBy(*keys).orderBy("pos") if keys else Window.partitionBy(F.lit(0)).orderBy("pos")
    block = ordered.id_block("pos", size)
    assert same(ordered.previous(rows, ["v"], ["pos"], block, keys), rows.withColumn("prev_v", F.lag("v").over(w)))
    assert same(ordered.following(rows, ["v"], ["pos"], block, keys), rows.withColumn("next_v", F.lead("v").over(w)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert same(
        ordered.carry_last(rows, {"c": F.col("v")}, ["pos"], block, keys), rows.withColumn("c", F.last("v", True).over(upto)))
    assert same(
        ordered.running_sum(rows, {"s": F.coalesce("v", F.lit(0.0))}, ["pos"], block, keys),
        rows.withColumn("s", F.sum(F.coalesce("v", F.lit(0.0))).over(upto)))


@pytest.mark.parametrize("size", [1, 13, 10**6])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_runs(rows, size, keys):
    w = Window.partitionBy(*keys).orderBy("pos") if keys else Window.partitionBy(F.lit(0)).orderBy("pos")
    x = rows.withColumn("n", F.when(F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1))
    x = x.withColumn("g", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    plain = x.groupBy(*keys, "g").agg(F.first("state").alias("state"), F.min("pos").alias("start_pos"), F.count(F.lit(1)).alias("cnt"), F.max("v").alias("m")).drop("g")
    out = ordered.runs(rows, ["state"], ["pos"], ordered.id_block("pos", size), keys, {"m": ("max", "v")})
    assert same(out, plain)


@pytest.mark.parametrize("size", [1, 13, 10**6])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_islands(rows, size, keys):
    w = Window.partitionBy(*keys).orderBy("pos") if keys else Window.partitionBy(F.lit(0)).orderBy("pos")
    x = rows.withColumn("n", F.when(F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1))
    plain = x.withColumn("g", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_pos", F.lead("pos").over(w)).drop("n")
    differs = lambda a, b: a["state"] != b["state"]
    out = ordered.islands(rows, ["state", "pos"], differs, ["pos"], ordered.id_block("pos", size), keys, "g", ["pos"])
    assert same(out, plain)


def expected_statistics(values):
    """The rule, written out over a plain list."""
    import math

    n = len(values)
    if n == 0:
        return 0, 0, 0
    lo, hi = min(values), max(values)
    if n == 1 or lo == hi:
        return hi, hi, 0
    if n == 2:
        mean = (lo + hi) / 2
        return hi, mean, math.sqrt(2 * (hi - mean) ** 2)
    slots = {}
    for v in values:
        b = 0 if v < 1e-6 else min(999, int(hist.OFFSET + math.log(v) / math.log(1.05)))
        slots[b] = slots.get(b, 0) + 1
    val = lambda b: 0 if b == 0 else 1.05 ** (b - 1) * 1e-6
    cut = int(n * 0.95) if n >= 10 else n
    seen, p, median, above = 0, None, None, 999
    for b in sorted(slots, reverse=True):
        seen += slots[b]
        if p is None and seen > n - cut:
            p = val(b)
        if median is None and n - seen <= n // 2:
            median = val(b) if cut % 2 or slots[b] > 1 else (val(b) + val(above)) / 2
        above = b
    mean = sum(c * val(b) for b, c in slots.items()) / n
    sq = sum(c * val(b) ** 2 for b, c in slots.items()) / n
    return p, median, min(math.sqrt(max(0, sq - mean**2)), (hi - lo) / 2)


def test_histogram_statistics(spark):
    rnd = random.Random(1)
    cases = {n: [rnd.lognormvariate(0, 2) for _ in range(n)] for n in (1, 2, 3, 9, 10, 11, 100, 777)}
    cases[5000] = [4.2] * 50
    cases[5001] = [0.0, 0.0, 1e-7, 5.0]
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k int, v double")
    x = dg.digest(df, ["k"], numeric=["v"]).select("k", "cnt", "min", "max")
    out = hist.statistics(hist.histogram(df, ["k"], ["v"]).drop("attribute"), x, ["k"])
    got = {r.k: (r.pct_95, r.median, r.stddev) for r in out.collect()}
    for k, values in cases.items():
        assert got[k] == pytest.approx(expected_statistics(values), rel=1e-9, abs=1e-9), k
    counts = hist.histogram(df, ["k"], ["v"]).groupBy("k").agg(F.sum("n").alias("n"))
    assert {r.k: r.n for r in counts.collect()} == {k: len(v) for k, v in cases.items()}


def test_empty_statistics(spark):
    df = spark.createDataFrame([], "k int, bucket int, n long")
    x = spark.createDataFrame([(1, 0, None, None)], "k int, cnt long, min double, max double")
    assert tuple(hist.statistics(df, x, ["k"]).collect()[0])[1:4] == (0.0, 0.0, 0.0)


def test_grouped_counts(spark):
    rows = [("bob", 123, 3, 20), ("stan", 124, 5, 23), ("fred", 121, 5, 20), ("charlie", 125, 4, 28), ("bob", 123, 3, 20), ("charlie", 125, 5, 28), ("bob", 124, 3, 20)]
    df = spark.createDataFrame(rows, "name string, date int, activity int, age int")
    assert {r.name: r.n for r in dg.grouped_counts(df, "name").collect()} == {"bob": 3, "charlie": 2, "stan": 1, "fred": 1}
    got = {(r.name, r.date): r.n for r in dg.grouped_counts(df, "name", "date").collect()}
    assert got == {("charlie", 125): 2, ("bob", 123): 2, ("bob", 124): 1, ("fred", 121): 1, ("stan", 124): 1}
    with pytest.raises(ValueError):
        dg.grouped_counts(df, "nope")


def test_trimmed_statistics_hot_value(spark):
    rnd = random.Random(3)
    data = [("k", rnd.choice([5.0, 5.0, rnd.uniform(-50, 50)])) for _ in range(2000)] + [("one", 7.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in dg.trimmed_statistics(df, ["k"], "v", 95).collect()}
    kept = sorted(v for k, v in data if k == "k")[: 2000 * 95 // 100]
    assert got["k"].cnt == len(kept) and got["k"].sum == pytest.approx(sum(kept)) and got["k"].max == max(kept)
    assert "one" not in got


def test_top_classes_without_count_limit(spark):
    data = [(f"c{i}", float(v)) for i, v in enumerate([100, 50, 25, 10, 5, 5, 1])]
    df = spark.createDataFrame(data, "c string, s double")
    out = dg.top_classes(df, "s", "c", total_limit=170.0)
    assert sorted(r.c for r in out.collect()) == ["c0", "c1", "c2"]
    out = dg.top_classes(df, "s", "c", count_limit=1, outlier=F.col("s") == 5)
    assert sorted((r.c, r.reason) for r in out.collect()) == [("c0", "top"), ("c4", "outlier"), ("c5", "outlier")]
