"""Logarithmic histogram: 1,000 buckets, each 5 % wider than the last, from 1e-6.

A class and attribute never holds more than 1,000 bucket rows, so percentiles
cost a partial aggregation and a window over a bounded partition, whatever the
number of events.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values. -------------------------------------------------------------
BASE = 1.05
BUCKETS = 1000
MIN_VALUE = 1e-6
OFFSET = abs(1 - math.log(MIN_VALUE) / math.log(BASE))
DECADE_LABELS = ("1us", "10us", "100us", "1ms", "10ms", "100ms", "1s", "10s+")
BAR_WIDTH = 64
# --------------------------------------------------------------------------------


def bucket_index(value) -> Column:
    """Bucket of a value; the branch below 1e-6 is taken before the logarithm."""
    value = F.col(value) if isinstance(value, str) else value
    raw = F.floor(F.lit(OFFSET) + F.log(value) / F.lit(math.log(BASE)))
    return F.when(value < MIN_VALUE, F.lit(0)).otherwise(
        F.least(F.lit(BUCKETS - 1), raw)
    ).cast("int")


def bucket_value(bucket) -> Column:
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    return F.when(bucket == 0, F.lit(0.0)).otherwise(
        F.pow(F.lit(BASE), bucket - 1) * F.lit(MIN_VALUE)
    )


def decade_starts() -> list[int]:
    """First bucket of each power of ten from 10us to 10s."""
    edges = [(10**k) * MIN_VALUE for k in range(1, 8)]
    return [int(OFFSET + math.log(edge) / math.log(BASE)) for edge in edges]


def decade_of(bucket) -> Column:
    """Index 0..7 of the power of ten a bucket belongs to."""
    bucket = F.col(bucket) if isinstance(bucket, str) else bucket
    passed = [F.when(bucket >= start, 1).otherwise(0) for start in decade_starts()]
    total = passed[0]
    for one in passed[1:]:
        total = total + one
    return total


def buckets(df: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """``n, sum, min, max`` per (keys, attribute, bucket) of several numeric columns, in one pass.

    Class figures are sums over these rows, so one scan and one shuffle of at
    most 1,000 rows per class and attribute serve every statistic.
    """
    slots = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes])
    x = df.select(*keys, F.inline(slots)).filter("v is not null")
    return x.groupBy(*keys, "attribute", bucket_index("v").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def histogram(df: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Counts per (keys, attribute, bucket)."""
    return buckets(df, keys, attributes).select(*keys, "attribute", "bucket", "n")


def _with_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket rows with their value, the counts from above and the cut of the top 5 %."""
    down = Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
    b = (
        rows.withColumn("value", bucket_value("bucket"))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn("seen", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("above", F.lag("value").over(down))
    )
    return b.withColumn(
        "cut", F.when(F.col("total") >= 10, F.floor(F.col("total") * 0.95)).otherwise(F.col("total"))
    )


def _rank_aggregates() -> list[Column]:
    """The 95th percentile is the value of the highest bucket past the top 5 %, the
    median the value of the first bucket, from above, leaving at most half."""
    middle = (F.col("total") - F.col("seen")) <= F.floor(F.col("total") / 2)
    top_value = bucket_value(F.lit(BUCKETS - 1))
    at_middle = F.when(
        (F.col("cut") % 2 == 1) | (F.col("n") > 1), F.col("value")
    ).otherwise((F.col("value") + F.coalesce(F.col("above"), top_value)) / 2)
    return [
        F.max("cut").alias("cut"),
        F.max(F.when(F.col("seen") > F.col("total") - F.col("cut"), F.col("value"))).alias("p"),
        F.max_by(at_middle, F.when(middle, F.col("bucket"))).alias("m"),
        (F.sum(F.col("n") * F.col("value")) / F.max("total")).alias("mean"),
        (F.sum(F.col("n") * F.col("value") * F.col("value")) / F.max("total")).alias("square"),
    ]


def _finish() -> list[Column]:
    """The statistics from the aggregates and (cnt, min, max), with the exact small cases."""
    cnt, lo, hi = F.col("cnt"), F.col("min"), F.col("max")
    flat = (cnt == 1) | (hi == lo)
    pair = cnt == 2
    spread = F.col("square") - F.col("mean") * F.col("mean")
    half = (lo + hi) / 2
    deviation = (
        F.when(flat, F.lit(0.0))
        .when(pair, F.sqrt(2 * (hi - half) * (hi - half)))
        .otherwise(F.least(F.sqrt(F.greatest(spread, F.lit(0.0))), (hi - lo) / 2))
    )
    return [
        F.coalesce(F.when(flat | pair, hi).otherwise(F.col("p")), F.lit(0.0)).alias("pct_95"),
        F.coalesce(F.when(flat, hi).when(pair, half).otherwise(F.col("m")), F.lit(0.0)).alias("median"),
        F.coalesce(deviation, F.lit(0.0)).alias("stddev"),
        F.when(flat | pair, cnt).otherwise(F.col("cut")).alias("cutoff"),
    ]


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``cnt, sum, min, max, avg`` and the histogram statistics per key from bucket rows."""
    agg = _with_ranks(rows, keys).groupBy(*keys).agg(
        F.sum("n").alias("cnt"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), *_rank_aggregates()
    )
    return agg.select(*keys, "cnt", "sum", "min", "max", (F.col("sum") / F.col("cnt")).alias("avg"), *_finish())


def statistics(hist: DataFrame, extremes: DataFrame, keys: list[str]) -> DataFrame:
    """``pct_95, median, stddev, cutoff`` per key from counts and given extremes.

    ``hist`` has (keys, bucket, n); ``extremes`` has (keys, cnt, min, max).
    """
    if not keys:
        one = {"_all": F.lit(0)}
        return statistics(hist.withColumns(one), extremes.withColumns(one), ["_all"]).drop("_all")
    per_key = _with_ranks(hist, keys).groupBy(*keys).agg(*_rank_aggregates())
    return extremes.join(per_key, keys, "left").select(*keys, *_finish())


def distribution_bars(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per power of ten with bars of at most 64 marks (values under 1us left out)."""
    per_decade = (
        hist.filter("bucket > 0")
        .groupBy(*keys, decade_of("bucket").alias("decade"))
        .agg(F.sum("n").alias("n"))
    )
    largest = F.max("n").over(Window.partitionBy(*keys)) if keys else F.max("n").over(Window.partitionBy(F.lit(0)))
    marks = F.greatest(F.lit(1), F.floor(F.col("n") / (largest / F.lit(BAR_WIDTH)))).cast("int")
    labels = F.array(*[F.lit(x) for x in DECADE_LABELS])
    return per_decade.select(
        *keys,
        "decade",
        F.element_at(labels, F.col("decade") + 1).alias("label"),
        "n",
        F.repeat(F.lit("#"), marks).alias("bar"),
    )
