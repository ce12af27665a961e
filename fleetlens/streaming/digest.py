"""Interval reports and roll-ups of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import histogram as hist


def windowed_buckets(events: DataFrame, group_by: list[str], value: str, ts: str, interval: str, lateness: str) -> DataFrame:
    """Counts and extremes per (window, class, histogram bucket).

    One streaming aggregate with at most 1,000 rows of state per class and open
    window; every statistic of the report follows from its rows.
    """
    v = F.col(value).cast("double")
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).filter(v.isNotNull())
    return x.groupBy(F.window(ts, interval).alias("w"), *group_by, hist.bucket_index(v).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max")
    ).select(F.col("w.start").alias("start"), *group_by, "bucket", "n", "sum", "min", "max")


def window_report(buckets: DataFrame, group_by: list[str]) -> DataFrame:
    """The metrics of each window and class from its bucket rows (a batch)."""
    return hist.summarize(buckets, ["start", *group_by]).drop("cutoff")


def rollup_stream(points: DataFrame, series: list[str], ts: str, value: str, step: str, retention: str) -> DataFrame:
    """Average, largest and smallest value per series and step, open as long as step 1 is kept."""
    x = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, retention)
    return x.groupBy(F.window(ts, step).alias("w"), *series).agg(
        F.avg(value).alias("average"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("n")
    ).select(F.col("w.start").alias("bucket"), *series, "average", "max", "min", "n")
