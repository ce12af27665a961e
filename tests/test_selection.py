"""Selection by counted ranges against sorting."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import digest as dg
from fleetlens.operators import selection


def test_places_of_doubles(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002, 0.9999999999999999]
    values += [struct.unpack("<d", struct.pack("<q", rnd.getrandbits(63)))[0] for _ in range(2000)]
    values += [2.0**e * s for e in range(-1074, 1024) for s in (1, -1)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "v double")
    rows = df.select("v", selection.double_place(F.col("v")).alias("p")).collect()
    for r in rows:
        if r.v != r.v:
            assert r.p == 2**63 - 1
        elif r.v > 0:
            assert r.p == struct.unpack("<q", struct.pack("<d", r.v))[0], r.v
        else:
            assert r.p == -struct.unpack("<q", struct.pack("<d", -r.v or 0.0))[0], r.v


def plain_cut(rows, order, limit, weight):
    """Rows inside, by sorting; NULLs first, or last when descending."""

    out = list(rows)
    for i, descending in reversed(order):
        out.sort(key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0 if not isinstance(r[i], str) else ""), reverse=descending)
    total, inside = 0, []
    for r in out:
        if total < limit:
            inside.append((r, limit - total))
        total += weight(r)
    return inside


SCHEMA = "g string, d double, s string, t timestamp, i long, w long"


def made(n, rnd, texts):
    t0 = dt.datetime(2024, 1, 1)
    return [
        (rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1.5, 1.5, -2.0, rnd.uniform(-1, 1), 1e300, 2**60 + 0.0]), rnd.choice(texts), rnd.choice([None, t0 + dt.timedelta(microseconds=rnd.randrange(1000))]), i, rnd.randrange(4))
        for i in range(n)
    ]


@pytest.mark.parametrize("order,block", [
    ([("d", False), ("i", False)], 5), ([("d", True), ("i", True)], 10), ([("s", False), ("i", False)], 4), ([("s", True), ("t", False), ("i", False)], 10), ([("i", False)], 1000),
])
def test_cut_equals_sorting(spark, order, block):
    rnd = random.Random(str(order))
    texts = [None, "", "a", "same beginning of a text 1", "same beginning of a text 2", "same beginning of a text", "é", "z" * 30]
    rows = made(150, rnd, texts)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit, weight in ((40, None), (0, None), (25, "w")) if block == 5 else ((25, "w"),):
        got = selection.cut(df, order, F.lit(limit), ["g"], F.col(weight) if weight else None, block).collect()
        assert len(got) == len(rows)
        for g in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == g]
            wanted = plain_cut(mine, [(names.index(c), d) for c, d in order], limit, (lambda r: r[5]) if weight else (lambda r: 1))
            inside = {r.i: r.room for r in got if r.g == g and r.inside}
            assert set(inside) == {r[4] for r, _ in wanted}, (g, limit, weight)
            rooms = {r[4]: room for r, room in wanted}
            for i, room in inside.items():
                assert room is None and rooms[i] >= (rows[i][5] if weight else 1) or room == rooms[i]


def test_cut_by_a_share_without_groups(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    got = selection.cut(df, [("v", True), ("id", False)], F.col("_total") * 0.5, weight=F.col("v"), block=20).filter("inside").collect()
    wanted, total = [], 0
    for v, i in sorted(((r % 10, r) for r in range(1000)), key=lambda x: (-x[0], x[1])):
        if total < 2250:
            wanted.append(i)
        total += v
    assert sorted(r.id for r in got) == sorted(wanted)
    assert selection.cut(df.limit(0), [("v", True)], F.lit(5)).count() == 0


@pytest.mark.parametrize("k", [7, 999])
def test_kth(spark, k):
    rnd = random.Random(k)
    values = [rnd.choice([None, rnd.randrange(50), rnd.randrange(10**15)]) for _ in range(1000)]
    got = selection.kth(spark.createDataFrame([(v,) for v in values], "v long"), "v", k, block=10).collect()[0].last
    known = sorted(v for v in values if v is not None)
    assert got == known[min(k, len(known)) - 1]


def test_classes_of_equal_metric_and_narrow_values(spark):
    df = spark.createDataFrame([(f"c{i:05d}", 2.0) for i in range(500)], "c string, s double")
    top = dg.top_classes(df, "s", "c", total_limit=301.0, block=10)
    assert sorted(r.c for r in top.collect()) == [f"c{i:05d}" for i in range(151)]
    narrow = spark.createDataFrame([("k", 1.7e9 + i / 1024) for i in range(1000)], "k string, v double")
    got = dg.trimmed_statistics(narrow, ["k"], "v", 95, block=7).collect()[0]
    assert (got.cnt, got.min, got.max) == (950, 1.7e9, 1.7e9 + 949 / 1024)
