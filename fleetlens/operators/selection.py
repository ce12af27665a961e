"""The first rows of an order, up to a total, for groups of any size.

Where the running total of a group passes its limit is found by counting ranges: the
order is read as whole numbers (``places``), rows are counted in at most ``RANGES``
ranges of the number, and the one range in which the limit falls is cut again, until it
holds no more than a block of rows. Equal numbers go on with the next column of the
order. Only that block is ever sorted; every other row is told by a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import lineage

#: Rows that are sorted together at most, and the bits of a range's number (4,096 ranges of a group).
BLOCK_ROWS, BITS = 1_000_000, 12
RANGES = 1 << BITS
#: Bytes of a text that make one number.
CHUNK = 7


def double_place(v: Column) -> Column:
    """A long in the order of doubles: exponent and fraction as they are stored; NaN is last."""
    v = v.cast("double")
    size = F.abs(v)
    near = F.floor(F.log2(size))
    two = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(two(near) > size, near - 1).when(two(near + 1) <= size, near + 1).otherwise(near)
    normal = F.transform(F.array(exponent.cast("double")), lambda e: ((e + 1023).cast("long") * (1 << 52)) + ((size / two(e) - 1) * float(1 << 52)).cast("long"))[0]
    tiny = (size * float(2**537) * float(2**537)).cast("long")
    place = F.when(size < 2.0**-1022, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v == 0, F.lit(0).cast("long")).when(v < 0, -place).otherwise(place)


def text_place(v: Column, chunk: int) -> Column:
    """The number of the ``chunk``-th seven bytes of a text, zeros after its end."""
    part = F.hex(F.substring(v.cast("binary"), chunk * CHUNK + 1, CHUNK))
    return F.conv(F.rpad(part, 2 * CHUNK, "0"), 16, 10).cast("long")


FIRST = -(1 << 63)


def places(kind: T.DataType, col: Column, descending: bool = False):
    """Longs whose order, one after the other, is the column's: NULLs first, or last when descending. An endless iterator for texts."""

    def turned(x: Column) -> Column:
        return F.bitwise_not(x) if descending else x

    if isinstance(kind, (T.StringType, T.BinaryType)):
        chunk = 0
        while True:
            yield turned(F.coalesce(text_place(col, chunk), F.lit(FIRST)))
            chunk += 1
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = double_place(col)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(col).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        value = (col * F.lit(10**kind.scale)).cast("long")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        value = col.cast("long")
    else:
        raise TypeError(f"no order by places for {kind.simpleString()}")
    yield turned(F.coalesce(value, F.lit(FIRST)))
    if isinstance(kind, T.LongType):
        # The least long and NULL have one place.
        yield turned(F.when(col.isNull(), 0).otherwise(1).cast("long"))


def _all_places(df: DataFrame, order: list[tuple[str, bool]], longest: int):
    """Places of the columns of an order, one after the other; texts of ``longest`` bytes at most."""
    for name, descending in order:
        kind = df.schema[name].dataType
        text = isinstance(kind, (T.StringType, T.BinaryType))
        for i, place in enumerate(places(kind, F.col(f"_row.`{name}`"), descending)):
            if text and i * CHUNK >= max(longest, 1):
                break
            yield place


def cut(rows: DataFrame, order: list[tuple[str, bool]], limit: Column, keys: list[str] = (), weight: Column | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``inside``: whether the weights before a row come to less than the group's limit, and ``room``.

    ``order`` lists columns with whether they descend, and should tell rows of a group
    apart; those it does not come in any order. ``limit`` is an expression of group
    values: the keys, ``_rows`` (their number), ``_total`` (of the weights) and columns
    that are equal in a group. ``weight`` (1 by default) is not negative. ``room`` is what
    is left of the limit before a row of the range where it ends, NULL for all others:
    such a row that is inside is so with its whole weight. ``rows`` is read once per step
    and should be cheap to read; groups of up to ``block`` rows need no step.
    """
    keys = list(keys)
    names = rows.columns
    x = rows.withColumn("_w", weight if weight is not None else F.lit(1).cast("long"))
    key = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_"))
    x = x.withColumn("_key", key)
    texts = [n for n, _ in order if isinstance(rows.schema[n].dataType, (T.StringType, T.BinaryType))]
    longest = F.max(F.greatest(F.lit(0), *[F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n in texts])) if texts else F.lit(0)
    same = [F.first(F.col(f"`{c}`")).alias(c) for c in names if c not in keys]
    groups = x.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_total"), longest.alias("_longest"), *same).select("_key", "_key.*", "_rows", "_total", "_longest", *[c for c in names if c not in keys])
    found = lineage.written(groups.select("_key", limit.alias("_limit"), F.col("_rows").alias("_n"), F.lit(0).cast(rows.select((weight if weight is not None else F.lit(1).cast("long")).alias("w")).schema["w"].dataType).alias("_before"), "_longest"), "cut-groups")
    # Groups that need steps hold more than a block each, so there are few of them.
    bytes_ = found.filter(F.col("_n") > block).agg(F.max("_longest")).first()[0]
    levels = []
    x = x.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), "_w", "_key")
    found = found.drop("_longest").withColumns({"_level": F.lit(0), "_lo": F.lit(None).cast("long"), "_hi": F.lit(None).cast("long"), "_path": F.array().cast("array<bigint>")})
    for level, place in enumerate(_all_places(rows, order, bytes_) if bytes_ is not None else ()):
        levels.append(place)
        x = x.withColumn(f"_p{level}", place)
        large = (F.col("_n") > block) & (F.col("_level") == level)
        opened = large & (F.col("_lo").isNull() | (F.col("_lo") < F.col("_hi")))
        n_open = 1
        while n_open:
            found = lineage.written(_narrowed(x, found.filter(opened), level).unionByName(found.filter(~opened)), "cut-step")
            n_open, stuck = found.agg(F.count_if(opened), F.count_if(large & ~opened)).first()
        if not stuck:
            break
        # Ranges of one number that are still too large go on with the next place.
        stays = large & ~opened
        found = found.select(
            "_key", "_limit", "_n", "_before", F.when(stays, level + 1).otherwise(F.col("_level")).alias("_level"),
            F.when(~stays, F.col("_lo")).alias("_lo"), F.when(~stays, F.col("_hi")).alias("_hi"),
            F.when(stays, F.concat("_path", F.array("_lo"))).otherwise(F.col("_path")).alias("_path"),
        )
    return _told(x, found, len(levels), order)


def _in_path(level: int) -> Column:
    same = F.lit(True)
    for i in range(level):
        same = same & (F.col(f"_p{i}") == F.get("_path", F.lit(i)))
    return same


def _narrowed(x: DataFrame, open_: DataFrame, level: int) -> DataFrame:
    """For each open group the range in which its limit ends, out of those its last range is cut into."""
    place = F.col(f"_p{level}")
    here = x.join(open_, "_key").filter(_in_path(level) & (F.col("_lo").isNull() | place.between(F.col("_lo"), F.col("_hi"))))
    differ = F.col("_lo").bitwiseXOR(F.col("_hi"))
    # The first step of a place is by its highest bits, whatever its range; then by the highest in which the ends differ.
    shift = F.when(F.col("_lo").isNull(), F.lit(64 - BITS)).otherwise(F.greatest(F.lit(0), F.floor(F.log2(differ.cast("double"))).cast("int") + 1 - BITS))
    kept = [F.first(c).alias(c) for c in ("_limit", "_before", "_path", "_level")]
    ranges = here.withColumn("_range", F.call_function("shiftright", place, shift.cast("int"))).groupBy("_key", "_range").agg(
        F.sum("_w").alias("_in"), F.count(F.lit(1)).alias("_n"), F.min(place).alias("_lo"), F.max(place).alias("_hi"), *kept)
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    # The last range before which the limit is not reached; the first one where it is nothing.
    last = F.max_by(F.struct("_limit", "_n", F.col("_start").alias("_before"), "_level", "_lo", "_hi", "_path"), F.struct((F.col("_start") < F.col("_limit")).alias("under"), F.when(F.col("_start") < F.col("_limit"), F.col("_range")).otherwise(-F.col("_range"))))
    return ranges.groupBy("_key").agg(last.alias("_s")).select("_key", "_s.*")


def _told(x: DataFrame, found: DataFrame, levels: int, order: list[tuple[str, bool]]) -> DataFrame:
    """Every row against its group's range; the rows of the range by their order."""
    x = x.join(found.withColumnRenamed("_level", "_at"), "_key")
    side = F.lit(0)  # -1: before the range, 0: in it, 1: after it
    for i in reversed(range(levels)):
        p = F.col(f"_p{i}")
        fixed = F.get("_path", F.lit(i))
        ends = F.when(F.col("_lo").isNull(), 0).when(p < F.col("_lo"), -1).when(p > F.col("_hi"), 1).otherwise(0)
        side = F.when(F.col("_at") == i, ends).when(F.col("_at") < i, 0).when(p < fixed, -1).when(p > fixed, 1).otherwise(side)
    x = x.withColumn("_side", side)
    sorted_by = [F.col(f"_row.`{n}`").desc() if d else F.col(f"_row.`{n}`").asc() for n, d in order]
    upto = Window.partitionBy("_key").orderBy(*sorted_by).rowsBetween(Window.unboundedPreceding, -1)
    at_limit = x.filter("_side = 0").withColumn("room", F.col("_limit") - F.col("_before") - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    within = at_limit.select("_row.*", (F.col("room") > 0).alias("inside"), "room")
    if not levels:
        return within
    none = F.lit(None).cast(within.schema["room"].dataType)
    return within.unionByName(x.filter("_side <> 0").select("_row.*", (F.col("_side") < 0).alias("inside"), none.alias("room")))


def kth(rows: DataFrame, column: str, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """One row with ``last``: the ``k``-th smallest value of a column, the largest where there are fewer; NULLs are left out."""
    values = rows.select(F.col(f"`{column}`").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    inside = cut(lineage.written(values, "kth"), [("v", False)], F.lit(k), weight=F.col("n"), block=block)
    return inside.filter("inside").agg(F.max("v").alias("last"))
