"""Tracked catalogue rows: versions, snapshots, differences, sizes and growth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import privileges as pv
from fleetlens.operators import ordered

TABLE_KEY = ("server", "database_name", "table_name")
STATUSES = ("unreachable", "deleted", "new", "changed", "unchanged")


def _all_null(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])


def _differs(cols: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(prefix + c)) for c in cols])


def as_of(statistics: DataFrame, links: DataFrame, collector_run_id: int, txn: int | None = None) -> DataFrame:
    """Rows of a collector at a snapshot; too high or negative means the latest."""
    mine = links.filter(F.col("collector_run_id") == collector_run_id)
    latest = mine.agg(F.max("txn")).scalar()
    wanted = latest if txn is None or txn < 0 else F.least(F.lit(txn), latest)
    at = mine.filter(F.col("txn") == wanted).select(F.col("statistic_id").alias("id"), "txn")
    return statistics.join(at, "id", "inner")


def with_previous(rows: DataFrame, cols: list[str], keys=TABLE_KEY, id_col: str = "id",
                  block: Column | None = None) -> DataFrame:
    """Each version beside the one before it (greatest smaller id of the same key)."""
    block = block if block is not None else ordered.id_block(id_col)
    return ordered.previous(rows, [id_col, *cols], [id_col], block, list(keys))


def version_status(rows: DataFrame, payload: list[str], deleted_if: list[str], keys=TABLE_KEY,
                   names: list[str] = ("database_name", "table_name"), id_col: str = "id",
                   block: Column | None = None) -> DataFrame:
    """``status`` of each version: unreachable > deleted > new > changed > unchanged.

    A row is *deleted* when all of ``deleted_if`` are NULL, *unreachable* when
    the names are NULL too; *new* when first or after a deleted one.
    """
    extra = sorted(set(payload) | set(deleted_if))
    x = with_previous(rows, extra, keys, id_col, block)
    first = F.col(f"prev_{id_col}").isNull()
    prev_deleted = ~first & _all_null(*[f"prev_{c}" for c in deleted_if])
    status = (
        F.when(_all_null(*names, *deleted_if), F.lit("unreachable"))
        .when(_all_null(*deleted_if), F.lit("deleted"))
        .when(first | prev_deleted, F.lit("new"))
        .when(_differs(payload, "prev_"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return x.withColumn("status", status).select(*rows.columns, "status")


def history(rows: DataFrame, key: dict[str, str], until_id: int, since, id_col: str = "id") -> DataFrame:
    """Versions of one object up to a version, since a time."""
    same = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in key.items()])
    return rows.filter(same & (F.col(id_col) <= until_id) & (F.col("run_time") >= since))


def last_versions(rows: DataFrame, keys=TABLE_KEY, id_col: str = "id", at=None) -> DataFrame:
    """The last row of each key, or the last up to a time; no sort, one partial aggregate."""
    x = rows if at is None else rows.filter(F.col("run_time") <= at)
    rest = [c for c in rows.columns if c not in keys]
    best = x.groupBy(*keys).agg(F.max_by(F.struct(*rest), id_col).alias("_r"))
    return best.select(*keys, "_r.*").select(*rows.columns)


def catalog_changes(current: DataFrame, last: DataFrame, keys=TABLE_KEY, payload: list[str] = ("create_syntax",)) -> DataFrame:
    """``new``, ``changed`` and ``deleted`` objects of a catalogue against its last versions.

    A last version whose payload is all NULL counts as deleted already.
    """
    payload = list(payload)
    cur = current.select(*keys, F.struct(*payload).alias("_cur"))
    known = last.select(*keys, F.struct(*payload).alias("_old"))
    x = cur.join(known, list(keys), "full_outer")
    old_gone = reduce(lambda a, b: a & b, [F.col(f"_old.{c}").isNull() for c in payload])
    differs = reduce(
        lambda a, b: a | b, [~F.col(f"_cur.{c}").eqNullSafe(F.col(f"_old.{c}")) for c in payload]
    )
    change = (
        F.when(F.col("_cur").isNull() & ~old_gone, F.lit("deleted"))
        .when(F.col("_cur").isNotNull() & (F.col("_old").isNull() | old_gone), F.lit("new"))
        .when(F.col("_cur").isNotNull() & differs, F.lit("changed"))
    )
    return x.withColumn("change", change).filter("change is not null").select(
        *keys, *[F.col(f"_cur.{c}").alias(c) for c in payload],
        *[F.col(f"_old.{c}").alias(f"old_{c}") for c in payload], "change",
    )


def privilege_rows(levels: dict[str, DataFrame]) -> DataFrame:
    """Rows of the six levels in one schema: server, permtype, key fields, flags array."""
    fields = sorted({k for keys in pv.LEVEL_KEYS.values() for k in keys})
    parts = []
    for level, df in levels.items():
        have = [f for f in pv.FLAGS if f in df.columns]
        flags = F.col("flags") if "flags" in df.columns else pv.flags_from_row(have)
        wanted = pv.LEVEL_KEYS[level]
        cols = [(F.col(f) if f in wanted else F.lit(None)).cast("string").alias(f) for f in fields]
        parts.append(df.select("server", F.lit(pv.LEVEL_BITS[level]).alias("permtype"), *cols, F.array_sort(flags).alias("flags")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def privilege_changes(current: DataFrame, last: DataFrame) -> DataFrame:
    """New, changed and deleted privilege rows across all levels, by level-specific keys."""
    fields = [c for c in current.columns if c != "flags"]
    key = F.struct(*[F.col(c) for c in fields])
    a = current.select(key.alias("k"), F.col("flags").alias("flags"))
    b = last.select(key.alias("k"), F.col("flags").alias("old_flags"))
    x = a.join(b, "k", "full_outer")
    change = (
        F.when(F.col("flags").isNull(), F.lit("deleted"))
        .when(F.col("old_flags").isNull(), F.lit("new"))
        .when(F.col("flags") != F.col("old_flags"), F.lit("changed"))
    )
    return x.withColumn("change", change).filter("change is not null").select("k.*", "flags", "old_flags", "change")


def next_txn(links: DataFrame) -> Column:
    """The next transaction number as a scalar subquery."""
    return F.coalesce(links.agg(F.max("txn")).scalar(), F.lit(0)) + 1


def snapshot_rows(links: DataFrame, written: DataFrame, collector_run_id: int, run_time) -> DataFrame:
    """Link rows of the next snapshot: carried ids, and new ids with their parent.

    ``written`` has ``new_id`` and ``old_id`` (NULL for a first version).
    """
    mine = links.filter(F.col("collector_run_id") == collector_run_id)
    latest = mine.agg(F.max("txn")).scalar()
    prev = mine.filter(F.col("txn") == latest)
    carried = prev.join(written.select(F.col("old_id").alias("statistic_id")), "statistic_id", "left_anti").select(
        "statistic_id", F.lit(None).cast("long").alias("parent_txn")
    )
    parents = mine.groupBy(F.col("statistic_id").alias("old_id")).agg(F.max("txn").alias("parent_txn"))
    fresh = written.join(parents, "old_id", "left").select(
        F.col("new_id").alias("statistic_id"), F.col("parent_txn").cast("long")
    )
    return carried.unionByName(fresh).select(
        F.lit(collector_run_id).alias("collector_run_id"), "statistic_id",
        next_txn(links).alias("txn"), "parent_txn", F.lit(run_time).cast("timestamp").alias("run_time"),
    )


def snapshot_difference(previous: DataFrame, current: DataFrame, id_col: str = "statistic_id") -> DataFrame:
    """Ids gone from the snapshot, and ids new in it."""
    a, b = previous.select(id_col).distinct(), current.select(id_col).distinct()
    gone = a.join(b, id_col, "left_anti").withColumn("side", F.lit("removed"))
    return gone.unionByName(b.join(a, id_col, "left_anti").withColumn("side", F.lit("added")))


def unreachable_markers(hosts: DataFrame, last: DataFrame) -> DataFrame:
    """Hosts that need a marker row: unreachable now and not marked last time."""
    marked = last.filter("unreachable").select("server")
    return hosts.join(marked, "server", "left_anti")


def sizes(volumes: DataFrame, levels=("server", "database_name")) -> DataFrame:
    """Data and index bytes per server and per database; unreachable rows skipped, 0 as NULL."""
    x = volumes.filter(~_all_null("database_name", "table_name", "data_length", "index_length"))
    groups = [[F.col(c) for c in levels[: i + 1]] for i in range(len(levels))]
    out = x.groupingSets(groups, *[F.col(c) for c in levels]).agg(
        F.sum("data_length").alias("data_length"), F.sum("index_length").alias("index_length")
    )
    return out.select(*levels, F.nullif("data_length", F.lit(0)).alias("data_length"),
                      F.nullif("index_length", F.lit(0)).alias("index_length"))


def cached_sizes(volumes: DataFrame) -> DataFrame:
    """Total bytes of each server, schema and table from a run."""
    size = F.coalesce("data_length", F.lit(0)) + F.coalesce("index_length", F.lit(0))
    roll = volumes.filter("database_name is not null").select(*TABLE_KEY, size.alias("size")).rollup(*TABLE_KEY).agg(
        F.sum("size").alias("cached_size"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 0, "table").when(F.col("_g") == 1, "schema").when(F.col("_g") == 3, "server")
    return roll.withColumn("level", level).filter("level is not null").select("level", *TABLE_KEY, "cached_size")


def growth(volumes: DataFrame, since, size: Column, keys=TABLE_KEY, id_col: str = "id") -> DataFrame:
    """First and last size of each table in a period, absolute and relative change.

    Tables deleted at either end are left out; growth from zero is NULL.
    """
    x = volumes.filter(F.col("run_time") > since).select(*keys, F.col(id_col).alias("_id"), size.alias("_s"))
    g = x.groupBy(*keys).agg(
        F.min_by(F.struct("_s"), "_id").alias("_f"), F.max_by(F.struct("_s"), "_id").alias("_l")
    ).select(*keys, F.col("_f._s").alias("first_size"), F.col("_l._s").alias("last_size"))
    change = F.col("last_size") - F.col("first_size")
    return g.filter("first_size is not null and last_size is not null").select(
        "*", change.alias("change"), (change / F.nullif("first_size", F.lit(0))).alias("growth")
    )


def database_growth(table_growth: DataFrame, keys=("server", "database_name")) -> DataFrame:
    g = table_growth.groupBy(*keys).agg(
        F.sum("first_size").alias("first_size"), F.sum("last_size").alias("last_size"), F.sum("change").alias("change")
    )
    return g.withColumn("growth", F.col("change") / F.nullif("first_size", F.lit(0)))


def top_by_size(tables: DataFrame, n: int, size: str = "cached_size", server=None, schema=None, tie=()) -> DataFrame:
    """The largest tables overall, of a server or of a schema."""
    x = tables
    if server is not None:
        x = x.filter(F.col("server") == server)
    if schema is not None:
        x = x.filter(F.col("database_name") == schema)
    return x.orderBy(F.col(size).desc(), *tie).limit(n)


def change_counts(statuses: DataFrame) -> DataFrame:
    """One row: how many of each status, and whether an empty report should be sent."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    changed = F.count_if(F.col("status").isin("new", "changed", "deleted", "unreachable"))
    return statuses.agg(*counts, (changed > 0).alias("send"))


def report_query(df: DataFrame, select=("*",), where=None, since=None, group=(), order=(), limit=None,
                 time_col: str = "run_time") -> DataFrame:
    """Select, filter, group, order and cut, over trusted SQL expressions."""
    x = df if since is None else df.filter(F.col(time_col) >= since)
    if where is not None:
        x = x.filter(F.expr(where))
    x = x.groupBy(*group).agg(*[F.expr(e) for e in select]) if group else x.selectExpr(*select)
    if order:
        x = x.orderBy(*[F.expr(o) if isinstance(o, str) else o for o in order])
    return x if limit is None else x.limit(limit)


def consolidate(points: DataFrame, series: list[str], ts: str, value: str, step: int, now,
                archives: tuple[tuple[int, int], ...]) -> DataFrame:
    """Roll-ups of a series at multiples of its step, each kept for its own age.

    ``archives`` holds (factor, keep seconds). A bucket is NULL when more than
    a quarter of its steps have no value. Every archive comes from the same
    aggregate at the base step; the raw points are read once.
    """
    secs = F.unix_seconds(F.col(ts).cast("timestamp"))
    base = points.filter(F.col(value).isNotNull()).groupBy(*series, F.floor(secs / step).alias("_s")).agg(F.avg(value).alias("_v"))
    plans = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(k).cast("long").alias("keep")) for f, k in archives])
    x = base.select(*series, "_s", "_v", F.inline(plans)).withColumn("_b", F.floor(F.col("_s") / F.col("factor")))
    limit = F.unix_seconds(F.lit(now).cast("timestamp")) - F.col("keep")
    x = x.filter((F.col("_b") + 1) * F.col("factor") * step > limit)
    known = F.count(F.lit(1)) >= F.col("factor") * 0.75
    return x.groupBy(*series, "factor", "_b").agg(
        F.when(known, F.avg("_v")).alias("average"), F.when(known, F.max("_v")).alias("max"), F.when(known, F.min("_v")).alias("min")
    ).select(
        *series, "factor", F.timestamp_seconds(F.col("_b") * F.col("factor") * step).alias("bucket"), "average", "max", "min"
    )


# --- Fixed values: archive factors and how long each is kept. ---------------------
ARCHIVES = (
    (1, 48 * 3600), (2, 14 * 86400), (4, 31 * 86400),
    (8, 183 * 86400), (16, 366 * 86400), (32, 731 * 86400),
)
# -----------------------------------------------------------------------------------


def size_series(volumes: DataFrame, loaded: DataFrame | None = None, last_update: DataFrame | None = None) -> DataFrame:
    """Points per run at server, database and table level, without those already loaded.

    ``loaded`` has (server, database_name, table_name, run_time) already stored;
    ``last_update`` has the run after which an object takes no more points.
    """
    x = volumes.filter(~_all_null("database_name", "table_name", "data_length", "index_length"))
    keys = list(TABLE_KEY)
    c = [F.col(k) for k in keys]
    out = x.groupingSets([[c[0], F.col("run_time")], [c[0], c[1], F.col("run_time")], [*c, F.col("run_time")]], *c, F.col("run_time")).agg(
        F.sum("data_length").alias("data_length"), F.sum("index_length").alias("index_length")
    )
    key = F.struct(*c)
    if loaded is not None:
        done = loaded.select(key.alias("_k"), "run_time")
        out = out.withColumn("_k", key).join(done, ["_k", "run_time"], "left_anti").drop("_k")
    if last_update is not None:
        ends = last_update.select(key.alias("_k"), F.col("last_run").alias("_end"))
        out = out.withColumn("_k", key).join(ends, "_k", "left").filter(
            F.col("_end").isNull() | (F.col("run_time") <= F.col("_end"))
        ).drop("_k", "_end")
    return out.select(*keys, "run_time", "data_length", "index_length")


def series_summary(points: DataFrame, series: list[str], ts: str, value: str, since) -> DataFrame:
    """Last, average, least and greatest value of each series since a time."""
    return points.filter(F.col(ts) >= since).groupBy(*series).agg(
        F.max_by(value, ts).alias("last"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def counter_deltas(samples: DataFrame, keys: list[str], ts: str, value: str, block: Column) -> DataFrame:
    """Difference of each counter to its previous sample, NULL for the first."""
    x = ordered.previous(samples, [ts, value], [ts], block, keys)
    return x.withColumn("delta", F.col(value) - F.col(f"prev_{value}")).drop(f"prev_{ts}", f"prev_{value}")
