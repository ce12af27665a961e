"""Selecting log events and catalogue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import dates
from fleetlens.operators import ordered

# --- Fixed values: attributes that are never aggregated unless asked for, -------
# --- and schemas that belong to the server itself. -------------------------------
IGNORED_ATTRIBUTES = (
    "arg", "cmd", "insert_id", "ip", "port", "Thread_id", "timestamp", "exptime",
    "flags", "key", "res", "val", "server_id", "offset", "end_log_pos", "Xid",
)
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema")
ROW_COUNTERS = ("Rows_sent", "Rows_examined", "Rows_affected", "Rows_read")
# -----------------------------------------------------------------------------------


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def since(df: DataFrame, ts: str, start, file: str = "file", pos: str = "pos") -> DataFrame:
    """Per file, drop events until the first with ``ts >= start``; keep all after it.

    One position per file is aggregated (map side first) and joined back, so a
    file of any size is never sorted in one task.
    """
    cut = ordered.first_position(df, F.col(ts) >= start, [pos], [file])
    kept = df.join(cut.filter("_first is not null"), file, "inner")
    return kept.filter(F.col(pos) >= F.col(f"_first.{pos}")).select(*df.columns)


def until(df: DataFrame, ts: str, end, file: str = "file", pos: str = "pos") -> DataFrame:
    """Per file, keep events before the first with ``ts >= end``."""
    cut = ordered.first_position(df, F.col(ts) >= end, [pos], [file])
    kept = df.join(cut, file, "left")
    before = F.col("_first").isNull() | (F.col(pos) < F.col(f"_first.{pos}"))
    return kept.filter(before).select(*df.columns)


def matching(df: DataFrame, predicate) -> DataFrame:
    """Events for which a SQL expression or column holds."""
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def alias_attributes(df: DataFrame, spec: str) -> DataFrame:
    """``"a|b|c"``: the first present attribute becomes ``a``; the others go away."""
    names = [n for n in spec.split("|") if n in df.columns]
    target = spec.split("|")[0]
    if not names:
        return df
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*rest, F.coalesce(*names).alias(target))


def select_attributes(df: DataFrame, select: list[str], keep: list[str] = (),
                      ignore: tuple[str, ...] = IGNORED_ATTRIBUTES) -> DataFrame:
    """``name:alt1:alt2`` picks the first present alternate; an empty list takes all but ``ignore``."""
    if not select:
        return df.select(*[c for c in df.columns if c not in ignore or c in keep])
    out = []
    for spec in select:
        present = [n for n in spec.split(":") if n in df.columns]
        if present:
            out.append(F.coalesce(*present).alias(spec.split(":")[0]))
    return df.select(*keep, *out)


def inherit_attributes(df: DataFrame, names: list[str], order: list[str], block: Column) -> DataFrame:
    """Fill NULLs with the last value seen before, across blocks and files."""
    filled = ordered.carry_last(df, {n: F.col(n) for n in names}, order, block)
    return filled.select(*df.columns)


def sample_per_class(df: DataFrame, class_col: str, n: int, order: list[str]) -> DataFrame:
    """First ``n`` events of each class. The rank filter is pushed below the shuffle by Spark."""
    w = Window.partitionBy(class_col).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def zero_admin(df: DataFrame, arg: str = "arg", counters=ROW_COUNTERS) -> DataFrame:
    """Row counters of administrator events count as zero."""
    admin = F.col(arg).rlike("administrator")
    present = [c for c in counters if c in df.columns]
    return df.withColumns({c: F.when(admin, F.lit(0)).otherwise(F.col(c)) for c in present})


def limit_attribute_value(df: DataFrame, value: str, limit: float, class_col: str,
                          order: list[str], block: Column) -> DataFrame:
    """Values over the limit become the class's previous accepted value, 0 at first."""
    accepted = F.when(F.col(value) <= limit, F.col(value))
    x = ordered.carry_last(df, {"_accepted": accepted}, order, block, [class_col])
    fixed = F.when(F.col(value).isNotNull(), F.coalesce(F.col("_accepted"), F.lit(0)).cast("double"))
    return x.withColumn(value, fixed).select(*df.columns)


def repair_number(col) -> Column:
    """Keep the leading number of a doubled time text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(col, r"\A(\d+(?:\.\d+)?)", 1).try_cast("double")


def by_verb(df: DataFrame, spec: str, verb: str = "verb") -> DataFrame:
    """``-*,+SELECT``: a list of allowed (+) and denied (-) verbs; ``*`` sets the default."""
    items = [s.strip() for s in spec.split(",") if s.strip()]
    default = not any(i == "-*" for i in items)
    allowed = [i[1:].upper() for i in items if i[0] == "+" and i != "+*"]
    denied = [i[1:].upper() for i in items if i[0] == "-" and i != "-*"]
    word = F.upper(F.col(verb))
    keep = F.when(word.isin(*denied), False) if denied else F.when(F.lit(False), False)
    keep = keep.when(word.isin(*allowed), True) if allowed else keep
    return df.filter(keep.otherwise(F.lit(default)))


def isolate(df: DataFrame, user=None, host=None, db=None, ids=None, grep=None,
            statement: str = "sql") -> DataFrame:
    """Only the given user, host, database or thread ids, and statements matching a pattern."""
    conds = []
    for name, wanted in (("user", user), ("host", host), ("db", db)):
        if wanted is not None:
            conds.append(F.col(name) == wanted)
    if ids is not None:
        conds.append(F.col("id").isin(*ids))
    if grep is not None:
        conds.append(F.col(statement).rlike(grep))
    return df.filter(_all(conds))


def plausible_times(df: DataFrame, *cols: str) -> DataFrame:
    """Reject times of 2^28 seconds and more."""
    return df.filter(_all([F.coalesce(F.col(c), F.lit(0)) < 2**28 for c in cols]))


def find_tables(df: DataFrame, name=None, engine=None, row_format=None, smaller_than=None,
                greater_than=None, age_pattern=None, older_than=None, newer_than=None) -> DataFrame:
    """Catalogue rows that meet all given tests; ages come from the table name."""
    size = F.coalesce(F.col("Data_length"), F.lit(0)) + F.coalesce(F.col("Index_length"), F.lit(0))
    conds = []
    if name is not None:
        conds.append(F.col("Name").rlike(name))
    if engine is not None:
        conds.append(F.lower("Engine") == engine.lower())
    if row_format is not None:
        conds.append(F.lower("Row_format") == row_format.lower())
    if smaller_than is not None:
        conds.append(size < smaller_than)
    if greater_than is not None:
        conds.append(size > greater_than)
    if age_pattern is not None:
        born = dates.age_from_name("Name", age_pattern)
        if older_than is not None:
            conds.append(born <= older_than)
        if newer_than is not None:
            conds.append(born >= newer_than)
        if older_than is None and newer_than is None:
            conds.append(born.isNotNull())
    return df.filter(_all(conds))


def report_ignore(df: DataFrame, patterns: list[str], parts=("server", "database_name", "table_name")) -> DataFrame:
    """Drop rows whose ``server.db.table`` matches any pattern."""
    name = F.concat_ws(".", *parts)
    return df.filter(~_any([name.rlike(p) for p in patterns]))


def search_hierarchy(tables: DataFrame, servers: DataFrame, pattern: str) -> DataFrame:
    """Tables whose full name matches, and servers whose own name matches."""
    hit = tables.filter(F.concat_ws(".", "server", "database_name", "table_name").rlike(pattern))
    own = servers.filter(F.col("server").rlike(pattern))
    empty = F.lit(None).cast("string")
    return hit.select(F.lit("table").alias("kind"), "server", "database_name", "table_name").unionByName(
        own.select(F.lit("server").alias("kind"), "server", empty.alias("database_name"), empty.alias("table_name"))
    )


def exclude_system(df: DataFrame, schema: str = "database_name", more: tuple[str, ...] = ()) -> DataFrame:
    return df.filter(~F.col(schema).isin(*SYSTEM_SCHEMAS, *more))


def by_history(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Compare a latest-history column with ``==``, ``>=``, ``<=`` or ``=~``."""
    col = F.col(column)
    if op == "=~":
        return df.filter(col.cast("string").rlike(str(value)))
    typed = F.lit(value)
    tests = {"==": col == typed, ">=": col >= typed, "<=": col <= typed}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return df.filter(tests[op])


def changed_settings(df: DataFrame, value: str = "value", default: str = "default") -> DataFrame:
    """Settings that differ from their default, NULL-safe."""
    return df.filter(~F.col(value).eqNullSafe(F.col(default)))


def active_processes(df: DataFrame, command: str = "command", time: str = "time") -> DataFrame:
    """Processes doing something, the longest last."""
    idle = F.lower(F.coalesce(F.col(command), F.lit(""))).isin("sleep", "binlog dump")
    return df.filter(~idle).orderBy(F.col(time).asc())
