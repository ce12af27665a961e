"""Catalogue reports: capacity, fragmentation, ratios, duplicates, indexes, bloat, locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import numbers

# --- Fixed values. ---------------------------------------------------------------------
OWN_LOCK = "virtualxid"
LOCK_MODES = (
    "AccessShareLock", "RowShareLock", "RowExclusiveLock", "ShareUpdateExclusiveLock",
    "ShareLock", "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
)
# ----------------------------------------------------------------------------------------


def ratio(part, whole) -> Column:
    """Percent, NULL over zero."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return p * 100 / F.nullif(w, F.lit(0))


def capacity(df: DataFrame, types: dict[str, str], above_percent: float) -> DataFrame:
    """Largest value of each integer column against the limit of its type, above a percent.

    All maxima come from one pass; only their single row is unpivoted.
    """
    one = df.agg(*[F.max(c).cast("decimal(20,0)").alias(c) for c in types])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.coalesce(F.col(c), F.lit(0)).alias("max_value"))
        for c, t in types.items()
    ])
    x = one.select(F.inline(rows)).withColumn("type_limit", numbers.integer_limit("column_type"))
    pct = F.round(F.col("max_value").cast("double") / F.col("type_limit").cast("double") * 100, 0)
    return x.withColumn("pct", pct).filter(F.col("pct") > above_percent)


def fragmentation(tables: DataFrame, min_free_mb: float = 0, min_mb: float = 0, max_mb: float | None = None,
                  engine: str = "innodb") -> DataFrame:
    """KiB of data, index and free space, current and expected size, per table."""
    used = F.col("data_length") + F.col("index_length")
    x = tables.filter((F.lower("engine") == engine) & (F.col("data_free") / 1048576 >= min_free_mb) & (used / 1048576 >= min_mb))
    if max_mb is not None:
        x = x.filter(used / 1048576 <= max_mb)
    kib = lambda c: F.round(c / 1024, 0)
    return x.select(
        "database_name", "table_name", kib(F.col("data_length")).alias("data_kib"), kib(F.col("index_length")).alias("index_kib"),
        kib(F.col("data_free")).alias("free_kib"), kib(used + F.col("data_free")).alias("current_kib"), kib(used).alias("expected_kib"),
    )


def fragmentation_total(fragments: DataFrame) -> DataFrame:
    cols = ("data_kib", "index_kib", "free_kib", "current_kib", "expected_kib")
    return fragments.agg(F.count(F.lit(1)).alias("tables"), *[F.sum(c).alias(c) for c in cols])


def table_ratios(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Dead rows, cache hits, reads against writes, and in-page updates, in percent."""
    agg = stats.groupBy(*keys).agg(*[
        F.sum(c).alias(c) for c in ("live", "dead", "hits", "reads", "read_rows", "written_rows", "updates", "hot_updates")
    ])
    return agg.select(
        *keys, ratio("dead", F.col("live") + F.col("dead")).alias("dead_pct"), ratio("hits", F.col("hits") + F.col("reads")).alias("hit_pct"),
        ratio("read_rows", F.col("read_rows") + F.col("written_rows")).alias("read_pct"), ratio("hot_updates", "updates").alias("hot_pct"),
    )


def duplicate_definitions(objects: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Definitions shared by several objects: how many, and each member on its own row.

    Members stay rows (the count is joined back), so a definition shared by a
    third of the catalogue is never gathered in one place.
    """
    groups = objects.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return objects.select(*keys, member).join(groups, keys)


def index_summary(tables: DataFrame, indexes: DataFrame, key: str = "table_name", columns: str = "n_columns") -> DataFrame:
    """Single- and multi-column index counts per table, tables without any included."""
    per = indexes.groupBy(key).agg(
        F.count_if(F.col(columns) == 1).alias("single_column"), F.count_if(F.col(columns) > 1).alias("multi_column"),
        F.count(F.lit(1)).alias("indexes"),
    )
    return tables.join(per, key, "left").fillna(0, ["single_column", "multi_column", "indexes"])


def bloat(relations: DataFrame, column_stats: DataFrame, indexes: DataFrame, block_size: int = 8192,
          header: int = 23, align: int = 4) -> DataFrame:
    """Pages in use against pages expected from column widths, for tables and their indexes.

    ``column_stats``: table_name, null_frac, avg_width. ``relations``:
    table_name, rows, pages. ``indexes``: table_name, index_name, rows, pages.
    """
    s = column_stats.groupBy("table_name").agg(
        F.sum((1 - F.col("null_frac")) * F.col("avg_width")).alias("width"), F.max("null_frac").alias("max_null"),
        F.count_if(F.col("null_frac") != 0).alias("nullable"),
    )
    null_header = F.lit(header) + 1 + F.floor(F.col("nullable") / 8)

    def padded(size: Column) -> Column:
        return F.lit(align) - F.when(size % align == 0, F.lit(align)).otherwise(size % align)

    s = s.withColumn("data_header", F.col("width") + header + padded(F.lit(header)))
    s = s.withColumn("null_part", F.col("max_null") * (null_header + padded(null_header)))
    room = F.lit(block_size - 20).cast("double")
    per_row = F.col("data_header") + align - F.when(F.col("data_header") % align == 0, F.lit(align)).otherwise(F.col("data_header") % align)
    x = relations.join(s, "table_name")
    expected = F.ceil(F.col("rows") * (per_row + F.col("null_part") + 4) / room)
    x = x.withColumn("expected_pages", expected)
    i = indexes.select("table_name", "index_name", F.col("rows").alias("index_rows"), F.col("pages").alias("index_pages"))
    x = x.join(i, "table_name", "left")
    index_expected = F.coalesce(F.ceil(F.col("index_rows") * (F.col("data_header") - 12) / room), F.lit(0))
    x = x.withColumn("index_expected", index_expected)
    return x.select(
        "table_name", "index_name",
        F.when(F.col("expected_pages") == 0, 0.0).otherwise(F.round(F.col("pages") / F.col("expected_pages"), 1)).alias("table_bloat"),
        F.when((F.col("index_expected") == 0) | (F.coalesce("index_pages", F.lit(0)) == 0), 0.0)
        .otherwise(F.round(F.col("index_pages") / F.col("index_expected"), 1)).alias("index_bloat"),
    )


def totals(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums per key (children of a parent, tables of a schema or instance) and how many there are."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *[F.sum(c).alias(c) for c in columns])


def with_grand_total(df: DataFrame, name: str = "total") -> DataFrame:
    """The row count of the whole beside each row, from a scalar subquery instead of one window."""
    return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())


def cluster_counters(databases: DataFrame, counters: list[str], backends: str, maximum) -> DataFrame:
    """Counter sums over all databases, and backends against the allowed maximum."""
    one = databases.agg(*[F.sum(c).alias(c) for c in counters], F.sum(backends).alias(backends))
    limit = maximum if isinstance(maximum, Column) else F.lit(maximum)
    return one.withColumn("max_backends", limit).withColumn("backends_pct", ratio(backends, "max_backends"))


def lock_counts(locks: DataFrame, keys: list[str], modes=LOCK_MODES, mode: str = "mode", kind: str | None = None) -> DataFrame:
    """Locks by mode as columns, zero for modes without any; with a ``kind`` column, locks of transactions on themselves are left out."""
    locks = locks if kind is None else locks.filter(~F.col(kind).eqNullSafe(OWN_LOCK))
    return locks.groupBy(*keys).agg(*[F.count_if(F.col(mode) == m).alias(m.lower()) for m in modes])


def lock_type_counts(locks: DataFrame, keys: list[str], kind: str = "locktype") -> DataFrame:
    """Locks by type, one row each."""
    return locks.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("cnt"))


def phrase_counts(lines: DataFrame, phrases: list[str], text: str = "value", file: str = "file") -> DataFrame:
    """Lines holding each phrase, per log file, in one pass."""
    return lines.groupBy(file).agg(*[F.count_if(F.col(text).contains(p)).alias(p) for p in phrases])


def highest(metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The largest of repeated metric values."""
    return metrics.groupBy(*keys).agg(F.max(value).alias(value))


def latency_index(status: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean running statements over queries per second, from two bounded inputs.

    ``status``: keys, ts, questions. ``samples``: keys, ts, running.
    """
    secs = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / F.lit(1e6)
    q = status.groupBy(*keys).agg(
        ((F.max_by("questions", "ts") - F.min_by("questions", "ts")) / F.nullif(secs, F.lit(0.0))).alias("qps")
    )
    r = samples.groupBy(*keys).agg((F.sum(F.col("running") - 1) / F.count(F.lit(1))).alias("mean_running"))
    index = F.coalesce(F.col("mean_running") / F.nullif("qps", F.lit(0.0)), F.lit(0.0))
    return q.join(r, keys).withColumn("latency_index", index)


def merge_metrics(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """Name/value rows of two sets; the second wins where both have a name."""
    both = base.select(*keys, "value", F.lit(0).alias("_p")).unionByName(override.select(*keys, "value", F.lit(1).alias("_p")))
    return both.groupBy(*keys).agg(F.max_by("value", "_p").alias("value"))


def size_candidates(stats: DataFrame, big_rows: int, many_scans: int) -> DataFrame:
    """Tables over two thresholds at once, worst first."""
    return stats.filter((F.col("rows") > big_rows) & (F.col("scans") > many_scans)).orderBy(F.col("rows").desc())
