"""Compare registered queries with their SQL in DuckDB.

    python tests/check_oracle.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v) if abs(v) < 2**53 else str(int(v))
    if isinstance(v, float):
        return "nan" if v != v else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(norm(r[i]) for i in order) for r in rows]


def compare(spark_df, con, sql):
    cols = spark_df.columns
    mine = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}", len(mine)
    key = repr
    a, b = sorted(mine, key=key), sorted(theirs, key=key)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n      {bad[0][0]}\n      {bad[0][1]}", len(a)
    return None, len(a)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            if name in oracle:
                problem, n = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                problem, n = None, len(fn(spark, sf_dir).collect())
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:34s} {n:7d} {time.time() - t0:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
