"""Window functions over long ordered logs, cut into bounded blocks.

``Window.orderBy`` without a partition, or partitioned by a key that may hold a
third of the table, puts that much data in one task. The functions here cut the
order into blocks of bounded size first: the window runs inside a block, and
what must cross a block edge (the last row, the last value, the sum) is one
small summary row per block, carried over by a window on those summaries only.

``block`` must be monotone in the order (``id_block``, ``time_block``), and the
``order`` columns must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def id_block(col, size: int = BLOCK_ROWS) -> Column:
    """Block of a dense sequence number or byte position."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / size).cast("long")


def time_block(col, seconds: int = 86400) -> Column:
    """Block of a time stamp; choose the width so that a block fits in a task."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_seconds(col.cast("timestamp")) / seconds).cast("long")


def _keyed(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    # One struct key: NULL-safe in joins, and the same hash partitioning serves
    # the window and the join that follows it.
    return df.withColumn("_k", F.struct(*[F.col(k) for k in keys], block.alias("_b")))


def _over_blocks(keys: list[str]) -> Window:
    part = [F.col(f"_k.{k}") for k in keys] or [F.lit(0)]
    return Window.partitionBy(*part).orderBy(F.col("_k._b"))


def previous(df: DataFrame, cols: list[str], order: list[str], block: Column,
             keys: list[str] = (), prefix: str = "prev_") -> DataFrame:
    """``lag`` of several columns by one row; NULLs for the first row of a key."""
    keys = list(keys)
    x = _keyed(df, keys, block)
    row = F.struct(*cols)
    edge = x.groupBy("_k").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    edge = edge.select("_k", F.lag("_last").over(_over_blocks(keys)).alias("_carry"))
    inside = Window.partitionBy("_k").orderBy(*order)
    x = x.withColumn("_prev", F.lag(row).over(inside)).withColumn("_n", F.row_number().over(inside))
    x = x.join(edge, "_k", "left")
    before = F.when(F.col("_n") > 1, F.col("_prev")).otherwise(F.col("_carry"))
    x = x.withColumn("_before", before)
    out = [F.col(f"_before.{c}").alias(prefix + c) for c in cols]
    return x.select(*[F.col(c) for c in df.columns], *out)


def following(df: DataFrame, cols: list[str], order: list[str], block: Column,
              keys: list[str] = (), prefix: str = "next_") -> DataFrame:
    """``lead`` of several columns by one row; NULLs for the last row of a key."""
    keys = list(keys)
    x = _keyed(df, keys, block)
    row = F.struct(*cols)
    edge = x.groupBy("_k").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    edge = edge.select("_k", F.lead("_first").over(_over_blocks(keys)).alias("_carry"))
    inside = Window.partitionBy("_k").orderBy(*order)
    x = x.withColumn("_next", F.lead(F.struct(row.alias("r"))).over(inside))
    x = x.join(edge, "_k", "left")
    after = F.when(F.col("_next").isNotNull(), F.col("_next.r")).otherwise(F.col("_carry"))
    x = x.withColumn("_after", after)
    out = [F.col(f"_after.{c}").alias(prefix + c) for c in cols]
    return x.select(*[F.col(c) for c in df.columns], *out)


def carry_last(df: DataFrame, cols: dict[str, Column], order: list[str], block: Column,
               keys: list[str] = (), include_current: bool = True) -> DataFrame:
    """Last non-null value of each expression so far, as new columns.

    Carries across blocks, and with no ``keys`` across files.
    """
    keys = list(keys)
    names = list(cols)
    x = _keyed(df, keys, block).withColumns({f"_v_{n}": e for n, e in cols.items()})
    position = F.struct(*order)
    edge = x.groupBy("_k").agg(
        *[
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}")
            for n in names
        ]
    )
    earlier = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        "_k", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names]
    )
    end = 0 if include_current else -1
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    x = x.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in names})
    x = x.join(edge, "_k", "left")
    kept = [F.col(c) for c in df.columns if c not in names]
    return x.select(*kept, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in names])


def running_sum(df: DataFrame, sums: dict[str, Column], order: list, block: Column,
                keys: list[str] = (), include_current: bool = True) -> DataFrame:
    """Running totals, as new columns; earlier blocks come in as one sum each.

    ``order`` may hold descending columns as long as ``block`` runs the same way.
    """
    keys = list(keys)
    names = list(sums)
    x = _keyed(df, keys, block).withColumns({f"_v_{n}": e for n, e in sums.items()})
    edge = x.groupBy("_k").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    earlier = _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("_k", *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in names])
    end = 0 if include_current else -1
    inside = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    x = x.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    x = x.join(edge, "_k", "left")

    def total(n: str) -> Column:
        zero = F.lit(0)
        return (F.coalesce(f"_i_{n}", zero) + F.coalesce(f"_c_{n}", zero)).alias(n)

    return x.select(*[F.col(c) for c in df.columns], *[total(n) for n in names])


def islands(df: DataFrame, cols: list[str], starts, order: list[str], block: Column, keys: list[str] = (),
            name: str = "island", following_cols: list[str] = ()) -> DataFrame:
    """Number the islands of each key: a row opens one when ``starts(previous, row)`` holds.

    ``starts`` gets two structs of ``cols``. The first row of a key always opens
    one. ``following_cols`` (among ``cols``) of the next row come as ``next_<col>``.
    Neighbours, counts and the next row come from the same block window and the
    same edge rows, so the input is read twice, the second time narrow.
    """
    keys = list(keys)
    row = F.struct(*cols)
    inside = Window.partitionBy("_k").orderBy(*order)
    x = _keyed(df, keys, block).withColumns({
        "_cur": row, "_prev": F.lag(row).over(inside), "_next": F.lead(F.struct(row.alias("r"))).over(inside),
        "_n": F.row_number().over(inside),
    })
    opens = F.when((F.col("_n") > 1) & F.coalesce(starts(F.col("_prev"), F.col("_cur")), F.lit(False)), 1).otherwise(0)
    x = x.withColumn("_open", opens)
    edge = x.groupBy("_k").agg(
        F.min_by("_cur", "_n").alias("_first"), F.max_by("_cur", "_n").alias("_last"), F.sum("_open").alias("_opened")
    )
    over = _over_blocks(keys)
    edge = edge.withColumns({"_before_first": F.lag("_last").over(over), "_ahead": F.lead("_first").over(over), "_b": F.row_number().over(over)})
    first_opens = F.when(
        (F.col("_b") == 1) | F.coalesce(starts(F.col("_before_first"), F.col("_first")), F.lit(False)), 1
    ).otherwise(0)
    edge = edge.withColumn("_first_opens", first_opens)
    earlier = F.sum(F.col("_opened") + F.col("_first_opens")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select("_k", "_ahead", (F.coalesce(earlier, F.lit(0)) + F.col("_first_opens")).alias("_base"))
    x = x.withColumn("_running", F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(edge, "_k", "left")
    after = F.when(F.col("_next").isNotNull(), F.col("_next.r")).otherwise(F.col("_ahead"))
    x = x.withColumn("_after", after)
    return x.select(
        *[F.col(c) for c in df.columns], (F.col("_base") + F.col("_running")).alias(name),
        *[F.col(f"_after.{c}").alias(f"next_{c}") for c in following_cols],
    )


def runs(df: DataFrame, value: list[str], order: list[str], block: Column,
         keys: list[str] = (), aggregates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Runs of equal ``value`` in order: one row per run.

    ``aggregates`` maps an output name to ``(kind, column)`` with kind one of
    sum, min, max, count, first, last. Runs are built inside each block; only
    the first and last run of a block can go on in a neighbour, and only those
    are stitched.
    """
    keys = list(keys)
    aggregates = dict(aggregates or {})
    aggregates.setdefault("cnt", ("count", order[-1]))
    at = F.struct(*order)
    inside = Window.partitionBy("_k").orderBy(*order)
    x = _keyed(df, keys, block).withColumn("_val", F.struct(*value))
    x = x.withColumn("_p", F.lag("_val").over(inside))
    starts = F.when(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_val")), 1).otherwise(0)
    x = x.withColumn("_start", starts)
    x = x.withColumn("_run", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    def build(kind: str, col: Column, where: Column) -> Column:
        if kind == "first":
            return F.min_by(col, where)
        if kind == "last":
            return F.max_by(col, where)
        if kind == "count":
            return F.count(F.lit(1))
        return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)

    partial = x.groupBy("_k", "_run").agg(
        F.first("_val").alias("_val"),
        F.min(at).alias("_at"),
        *[build(kind, F.col(col), at).alias(name) for name, (kind, col) in aggregates.items()],
    )
    w = Window.partitionBy("_k")
    partial = partial.withColumn("_lo", F.min("_run").over(w)).withColumn("_hi", F.max("_run").over(w))
    is_edge = (F.col("_run") == F.col("_lo")) | (F.col("_run") == F.col("_hi"))
    inner = partial.filter(~is_edge).withColumn("_g", F.lit(0).cast("long"))
    edge = partial.filter(is_edge)
    over = Window.partitionBy(*([F.col(f"_k.{k}") for k in keys] or [F.lit(0)])).orderBy("_at")
    same = F.lag("_val").over(over).eqNullSafe(F.col("_val")) & ~F.lag("_k").over(over).eqNullSafe(F.col("_k"))
    edge = edge.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    edge = edge.withColumn("_g", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))

    def merge(kind: str, name: str) -> Column:
        if kind in ("sum", "count"):
            return F.sum(name)
        return build(kind, F.col(name), F.col("_at"))

    edge = edge.groupBy(*[F.col(f"_k.{k}").alias(k) for k in keys], "_g").agg(
        F.first("_val").alias("_val"),
        F.min("_at").alias("_at"),
        *[merge(kind, name).alias(name) for name, (kind, _) in aggregates.items()],
    )
    columns = [*keys, "_val", "_at", *aggregates]
    inner = inner.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "_val", "_at", *aggregates)
    out = edge.select(*columns).unionByName(inner)
    return out.select(
        *keys,
        *[F.col(f"_val.{v}").alias(v) for v in value],
        *[F.col(f"_at.{o}").alias(f"start_{o}") for o in order],
        *aggregates,
    )


def first_position(df: DataFrame, condition: Column, order: list[str], keys: list[str]) -> DataFrame:
    """Per key, the first position where a condition holds (partial aggregation only)."""
    return df.groupBy(*keys).agg(F.min(F.when(condition, F.struct(*order))).alias("_first"))
