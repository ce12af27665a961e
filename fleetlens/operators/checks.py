"""Thresholds over metrics, processes, checksums, partitions and backups.

Every check returns rows with a ``status`` of OK, WARNING, CRITICAL or UNKNOWN,
so it runs the same over one server, a fleet or a stream's micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import ordered

# --- Fixed values. -----------------------------------------------------------------
IDLE_COMMANDS = r"(?i)(Sleep|Binlog Dump|Ping|Processlist)"
SYSTEM_USER = "system user"
OK, WARNING, CRITICAL, UNKNOWN = "OK", "WARNING", "CRITICAL", "UNKNOWN"
# ------------------------------------------------------------------------------------


def graded(critical: Column, warning: Column) -> Column:
    return F.when(critical, CRITICAL).when(warning, WARNING).otherwise(OK)


def compare(value: Column, op: str, threshold) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    tests = {">": value > t, "<": value < t, "=": value == t, "==": value == t, ">=": value >= t, "<=": value <= t}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op]


def watch(metrics: DataFrame, watches: DataFrame, keys: list[str], require_all: bool = False) -> DataFrame:
    """Metric rows against a table of (name, cmp, threshold); ``failed`` per tick.

    ``metrics`` is long: keys, name, value. Any failing watch fails the tick, or
    with ``require_all`` only all of them together.
    """
    x = metrics.join(watches, "name")
    v, t = F.col("value"), F.col("threshold")
    hit = F.when(F.col("cmp") == ">", v > t).when(F.col("cmp") == "<", v < t).when(F.col("cmp") == "=", v == t)
    hit = F.coalesce(hit, F.lit(False))
    total = watches.agg(F.count(F.lit(1))).scalar()
    agg = x.groupBy(*keys).agg(F.count_if(hit).alias("n_failed"))
    failed = F.col("n_failed") == total if require_all else F.col("n_failed") > 0
    return agg.withColumn("failed", failed)


def wide_metrics(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long metrics as one column per name (the names are given, so no extra scan)."""
    return metrics.filter(F.col("name").isin(*names)).groupBy(*keys).pivot("name", names).agg(F.max("value"))


def expression_check(wide: DataFrame, expression: str, op: str, warning: float, critical: float) -> DataFrame:
    """A SQL expression over metric columns, rounded to cents and graded."""
    value = F.round(F.expr(expression), 2)
    status = F.when(F.col("result").isNull(), UNKNOWN).otherwise(
        graded(compare(F.col("result"), op, critical), compare(F.col("result"), op, warning))
    )
    return wide.withColumn("result", value).withColumn("status", status)


def delta_check(current: DataFrame, last: DataFrame, keys: list[str], expression: str, op: str,
                warning: float, critical: float) -> DataFrame:
    """The same over two runs: columns of the last run carry the prefix ``last_``."""
    prev = last.select(*keys, *[F.col(c).alias(f"last_{c}") for c in last.columns if c not in keys])
    return expression_check(current.join(prev, keys, "left"), expression, op, warning, critical)


def long_queries(processes: DataFrame, keys: list[str], warning: float, critical: float) -> DataFrame:
    """Worst running time among real statements."""
    real = (
        ~F.coalesce(F.col("user"), F.lit("")).rlike(SYSTEM_USER)
        & ~F.coalesce(F.col("command"), F.lit("")).rlike(IDLE_COMMANDS)
        & F.col("info").isNotNull() & (F.col("info") != "") & (F.coalesce(F.col("time"), F.lit(0)) != 0)
    )
    t = F.when(real, F.col("time"))
    agg = processes.groupBy(*keys).agg(
        F.max(t).alias("max_time"), F.count_if(t > warning).alias("over_warning"), F.count_if(t > critical).alias("over_critical")
    )
    return agg.withColumn("status", graded(F.col("over_critical") > 0, F.col("over_warning") > 0))


def locked_queries(processes: DataFrame, keys: list[str], warning: float, critical: float) -> DataFrame:
    """Counts of locked statements over each threshold, and the longest."""
    t = F.when((F.col("state") == "Locked") & (F.col("command") == "Query"), F.col("time"))
    agg = processes.groupBy(*keys).agg(
        F.count_if(t >= critical).alias("critical_queries"),
        F.count_if((t >= warning) & (t < critical)).alias("warning_queries"),
        F.coalesce(F.max(t), F.lit(0)).alias("max_time"),
    )
    return agg.withColumn("status", graded(F.col("critical_queries") > 0, F.col("warning_queries") > 0))


def connections(processes: DataFrame, keys: list[str], warning: int, critical: int,
                commands=("Query", "Sleep", "Connect", "Binlog Dump")) -> DataFrame:
    """Connections by command, graded on their total."""
    named = [F.count_if(F.col("command") == c).alias(c.lower().replace(" ", "_")) for c in commands]
    other = F.count_if(~F.coalesce(F.col("command"), F.lit("")).isin(*commands)).alias("other")
    agg = processes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *named, other)
    return agg.withColumn("status", graded(F.col("total") >= critical, F.col("total") >= warning))


def slow_queries(processes: DataFrame, keys: list[str], seconds: float, warning: int, critical: int) -> DataFrame:
    """Number of statements running longer than a time."""
    slow = (F.col("command") == "Query") & (F.col("time") >= seconds)
    agg = processes.groupBy(*keys).agg(F.count_if(slow).alias("slow"))
    return agg.withColumn("status", graded(F.col("slow") >= critical, F.col("slow") >= warning))


def in_range(value: Column, spec: str) -> Column:
    """``low:high`` (numbers, inclusive), ``n`` (at least), or words (equal to either end)."""
    low, _, high = spec.partition(":")
    high = high if ":" in spec else low
    text = value.cast("string")
    word = text.isin(low, high)
    try:
        lo, hi = float(low), float(high)
    except ValueError:
        return F.coalesce(word, F.lit(False))
    number = text.try_cast("double")
    numeric = (number >= hi) if lo == hi else ((number >= lo) & (number <= hi))
    return F.coalesce(F.when(text.rlike(r"\d"), numeric).otherwise(word), F.lit(False))


def range_check(rows: DataFrame, keys: list[str], column: str, warning: str, critical: str, alert_on: str = "any") -> DataFrame:
    """Row-wise ranges, alerting on any row or only when all rows are in a range."""
    crit = in_range(F.col(column), critical)
    warn = in_range(F.col(column), warning) & ~crit
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(crit).alias("critical"), F.count_if(warn).alias("warning")
    )
    some = graded(F.col("critical") > 0, F.col("warning") > 0)
    every = F.when(F.col("critical") + F.col("warning") < F.col("rows"), OK).otherwise(
        F.when(F.col("critical") >= F.col("warning"), CRITICAL).otherwise(WARNING)
    )
    return agg.withColumn("status", every if alert_on == "all" else some)


def lag_band(rows: DataFrame, lag: str, warn_min: float, warn_max: float, crit_min: float, crit_max: float) -> DataFrame:
    """Lag below or above a band; critical is tested before warning on each side."""
    x = F.col(lag)
    status = (
        F.when(x.isNull() | (x < crit_min), CRITICAL).when(x < warn_min, WARNING)
        .when(x > crit_max, CRITICAL).when(x > warn_max, WARNING).otherwise(OK)
    )
    return rows.withColumn("status", status)


def heartbeat_lag(rows: DataFrame, beat: str, now) -> DataFrame:
    """Seconds since the last heartbeat, never negative."""
    at = F.unix_seconds(F.lit(now).cast("timestamp")) if not isinstance(now, Column) else F.unix_seconds(now.cast("timestamp"))
    return rows.withColumn("lag", F.greatest(F.lit(0), at - F.unix_seconds(F.col(beat).cast("timestamp"))))


def recent_checksums(checksums: DataFrame, differences: DataFrame, keys: list[str], since, critical: bool = True) -> DataFrame:
    """Whether recent checksums exist and agree, per host."""
    bad = CRITICAL if critical else WARNING
    seen = checksums.groupBy(*keys).agg(F.count_if(F.col("ts") >= since).alias("recent"))
    diff = differences.filter(F.col("ts") >= since).groupBy(*keys).agg(F.count(F.lit(1)).alias("different"))
    x = seen.join(diff, keys, "left").fillna(0, ["different"])
    return x.withColumn("status", F.when((F.col("recent") == 0) | (F.col("different") > 0), bad).otherwise(OK))


def future_partitions(partitions: DataFrame, keys: list[str], required, bound: str = "bound") -> DataFrame:
    """Whether the last bound (NULL is MAXVALUE, left out) reaches a date."""
    agg = partitions.groupBy(*keys).agg(F.max(bound).alias("last_bound"))
    short = F.col("last_bound").isNull() | (F.col("last_bound") < required)
    return agg.withColumn("status", F.when(short, CRITICAL).otherwise(OK))


def change_alert(statuses: DataFrame, patterns: list[str], parts=("server", "database_name", "table_name")) -> DataFrame:
    """Tables of interest whose last status is anything but unchanged."""
    name = F.concat_ws(".", *parts)
    wanted = F.lit(False)
    for p in patterns:
        wanted = wanted | name.rlike(p)
    bad = F.col("status").isin("changed", "new", "deleted", "unreachable")
    return statuses.filter(wanted & bad).withColumn("alert", F.lit(CRITICAL))


def backup_freshness(expected: DataFrame, backups: DataFrame, since) -> DataFrame:
    """Latest run of each expected (set, level): missing and failed ones are critical."""
    latest = backups.filter(F.col("backup_date") >= since).groupBy("backup_set", "backup_level").agg(
        F.max_by("backup_status", "backup_date").alias("backup_status"), F.max("backup_date").alias("backup_date")
    )
    x = expected.join(latest, ["backup_set", "backup_level"], "left")
    good = F.lower("backup_status").contains("succe")
    return x.withColumn("status", F.when(F.coalesce(good, F.lit(False)), OK).otherwise(CRITICAL))


def role_check(servers: DataFrame, read_only: str = "read_only", is_master: str = "is_master") -> DataFrame:
    """A master must be writable and a replica read-only."""
    wrong = F.col(read_only).eqNullSafe(F.col(is_master))
    return servers.withColumn("status", F.when(wrong, CRITICAL).otherwise(OK))


def job_outcomes(lines: DataFrame, keys: list[str], order: str, is_start: Column, is_success: Column, block: Column) -> DataFrame:
    """Jobs of a log: each start line succeeds if a success line comes before the next start.

    Only marker lines are kept before anything is ordered.
    """
    marks = lines.filter(is_start | is_success).select(*keys, order, is_start.alias("start"))
    nxt = ordered.following(marks, [order, "start"], [order], block, keys)
    ok = F.coalesce(~F.col("next_start"), F.lit(False))
    return nxt.filter("start").select(
        *keys, F.col(order).alias("started"), F.when(ok, F.col(f"next_{order}")).alias("ended"), ok.alias("success")
    )
