"""Name -> query function and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[["Tables"], DataFrame], str | None]] = {}


class Tables:
    """Parquet tables of one scale directory as attributes; times are read as UTC."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn

    return add


def rounded(df: DataFrame, places: int, *cols: str) -> DataFrame:
    """Round doubles so that the order of additions does not show."""
    return df.withColumns({c: F.round(c, places) for c in cols})


def when_ts(col) -> Column:
    """A timestamp without zone, as both engines print it."""
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("timestamp_ntz")
