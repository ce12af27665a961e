import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import processes, rules

T0 = dt.datetime(2024, 1, 1)


def follow(samples):
    """Finished statements by walking each connection's samples tick by tick."""
    ticks = sorted({s["ts"] for s in samples})
    out = []
    for cid in {s["id"] for s in samples}:
        at = {s["ts"]: s for s in samples if s["id"] == cid and s["info"]}
        head = None
        for t in ticks:
            cur, now = at.get(t), (t - T0).total_seconds()
            if head:
                ended = cur is None or cur["info"] != head["info"] or cur["time"] < head["time"]
                if not ended:
                    fudge = 1 if cur["time"] == int(cur["time"]) else 0.001
                    ended = now - cur["time"] - head["start"] - head["etime"] - cur["etime"] > fudge
                if ended:
                    out.append((cid, head["info"], head["ts"], max(head["time"], now - head["now"])))
                    head = None
            if cur and not head:
                head = {**cur, "now": now, "start": int(now - cur["time"])}
    return sorted(out)


def run(spark, samples):
    df = spark.createDataFrame(
        [("s", s["ts"], s["id"], float(s["time"]), s["info"], s["etime"]) for s in samples],
        "server string, ts timestamp, id long, time double, info string, etime double")
    return sorted((r.id, r.arg, r.first_seen, r.Query_time) for r in processes.sessions(df).collect())


def sample(sec, cid, time, info, etime=0.0):
    return {"ts": T0 + dt.timedelta(seconds=sec), "id": cid, "time": time, "info": info, "etime": etime}


def test_session_cases(spark):
    s = [sample(t, 9, 0, "tick") for t in range(0, 60, 10)]  # a connection that shows every tick
    s += [sample(0, 1, 3, "a"), sample(10, 1, 13, "a"), sample(20, 1, 1, "b")]  # text changes
    s += [sample(0, 2, 5, "a"), sample(10, 2, 2, "a")]  # time goes back
    s += [sample(0, 3, 5, "a"), sample(10, 3, 9, "a")]  # start drifts
    s += [sample(0, 4, 1, "a"), sample(20, 4, 21, "a")]  # away for one tick
    s += [sample(0, 5, 1, None), sample(10, 5, 11, "late")]  # idle, then busy
    got = run(spark, s)
    assert got == follow(s)
    assert (1, "a", T0, 20.0) in got and (4, "a", T0, 10.0) in got


def test_sessions_match_the_walk(spark):
    rnd = random.Random(11)
    s = []
    for cid in range(6):
        info, started = None, 0
        for sec in range(0, 1200, 10):
            if info is None or rnd.random() < 0.2:
                info, started = rnd.choice(["q1", "q2", None]), sec - rnd.randint(0, 4)
            if rnd.random() < 0.1:
                started += rnd.choice([1, 2, 5])  # slow drift
            if rnd.random() < 0.95:
                s.append(sample(sec, cid, max(0, sec - started), info, rnd.choice([0.0, 0.1])))
    assert run(spark, s) == follow(s)


RULES = ["kill Time > 10", "pass Time > 20", "kill User == 'Fred'", "pass User == 'Bob'", "kill Db == 'null'", "pass Host == 'special'"]


@pytest.mark.parametrize("row,verdict", [
    ((11, "test", "Randy", "localhost"), "kill"), ((21, "test", "Randy", "localhost"), "pass"), ((1, "test", "Fred", None), "kill"),
    ((1, "null", "Bob", "localhost"), "kill"), ((15, "null", "Fred", "special"), "pass"), ((1, None, "Bob", "localhost"), "kill"),
])
def test_rules(spark, row, verdict):
    df = spark.createDataFrame([row], "Time int, Db string, User string, Host string")
    assert rules.verdicts(df, rules.read_rules(RULES, df.columns)).collect()[0].verdict == verdict


def test_rule_now_and_errors(spark):
    df = spark.createDataFrame([(5, "x")], "Time int, User string")
    out = rules.verdicts(df, rules.read_rules(["kill now log Time >= 5", "pass Time >= 5"], df.columns)).collect()[0]
    assert (out.verdict, out.rule, out.log) == ("kill", 0, True)
    for bad in ("drop Time > 1", "kill Time", "kill Time > 1 xor Time > 2", "kill"):
        with pytest.raises(ValueError):
            rules.read_rules([bad], df.columns)


def test_find_processes(spark):
    df = spark.createDataFrame(
        [(1, "u", "Query", 5, "select"), (2, "u", "Query", 50, "select"), (3, "r", "Sleep", 90, None), (4, "r", "Query", 70, "update")],
        "id long, user string, command string, time long, info string")
    ids = lambda **k: sorted(r.id for r in processes.find_processes(df, **k).collect())
    assert ids(busy_time=10) == [2, 4]
    assert ids(busy_time=10, ignore={"user": "r"}) == [2]
    assert ids(idle_time=60) == [3]
    assert ids(match={"info": "^sel"}) == [1, 2]
    assert ids(ignore={"user": "r"}) == []
    assert ids(busy_time=10, only_oldest=True) == [4]


def test_counts(spark):
    df = spark.createDataFrame([("u", "h:1", None, "Query", "Locked", 3), ("u", "h:2", "d", "query", None, 4)],
                               "user string, host string, db string, command string, state string, time long")
    got = {(r.field, r.value): (r["count"], r.time) for r in processes.counts_by_field(df).collect()}
    assert got[("host", "h")] == (2, 7) and got[("command", "query")] == (2, 7) and got[("db", "NULL")] == (1, 3)
    row = processes.state_counts(df.withColumn("server", F.lit("s")), ["server"]).collect()[0]
    assert row.State_locked == 1 and row.State_other == 1 and row.State_init == 0
