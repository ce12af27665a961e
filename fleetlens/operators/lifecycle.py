"""Range partitions, retention, archives, pruning, merging and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import dates
from fleetlens.operators import lineage, selection

#: Bounds that are looked up together.
BOUNDS = 1024


# --- range partitions ---------------------------------------------------------------


def assign_partition(rows: DataFrame, partitions: DataFrame, value: str, bound: str = "bound", name: str = "name") -> DataFrame:
    """The range partition of each row: the first with ``value < bound`` (NULL bound is MAXVALUE).

    A NULL value belongs to the lowest partition; a value beyond all bounds to none.
    The sorted bounds are cut into blocks: a row finds its block among the blocks'
    last bounds, meets it by an equality join and finds its place there.
    """
    nth = F.row_number().over(Window.orderBy(F.col(bound).asc_nulls_last(), name)) - 1
    one = F.struct(F.col(bound).isNull().alias("open"), F.col(bound).alias("b"), F.col(name).alias("n"))
    blocks = partitions.select(F.floor(nth / BOUNDS).alias("_block"), one.alias("_p")).groupBy("_block").agg(F.sort_array(F.collect_list("_p")).alias("_bounds"))
    ends = blocks.agg(F.sort_array(F.collect_list(F.struct("_block", F.element_at("_bounds", -1).alias("last"))))).scalar()
    fits = lambda p: F.col(value).isNull() | p["open"] | (F.col(value) < p["b"])
    x = rows.withColumn("_ends", ends).withColumn("_block", F.get(F.filter("_ends", lambda e: fits(e["last"])), F.lit(0))["_block"]).drop("_ends")
    found = x.join(blocks, "_block", "left").withColumn("partition", F.get(F.filter("_bounds", fits), F.lit(0))["n"])
    return found.select(*rows.columns, "partition")


def plan_partitions(partitions: DataFrame, end: str, interval: str, prefix: str = "p", limit: int | None = None,
                    keys: list[str] = (), maxvalue_rows: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Partitions to add so that bounds reach ``end``: (keys, name, bound, reorganize).

    Names go on counting after the last; a MAXVALUE partition is split
    (``reorganize``) and comes back last with a NULL bound. ``maxvalue_rows``
    (keys, cnt) makes the plan fail when MAXVALUE holds data, unless forced.
    """
    step = F.expr(f"interval {interval}")
    # The last bounded partition must fit the prefix, and there must be one.
    number = F.regexp_extract("name", rf"\A\Q{prefix}\E(\d+)\z", 1).try_cast("int")
    number = F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("the name does not fit the prefix: "), "name")).cast("int"))
    last = partitions.groupBy(*keys).agg(
        F.max("bound").alias("_last"),
        F.max_by("name", F.when(F.col("bound").isNotNull(), F.col("bound"))).alias("name"),
        F.bool_or(F.col("bound").isNull()).alias("reorganize"),
    )
    none = F.raise_error(F.lit("no partition with a bound to go on from")).cast("date")
    last = last.withColumns({"_last": F.when(F.col("_last").isNotNull(), F.col("_last").cast("date")).otherwise(none), "_n": number})
    if maxvalue_rows is not None and not force:
        if keys:
            last = last.join(maxvalue_rows, list(keys), "left")
        else:
            last = last.withColumn("cnt", maxvalue_rows.agg(F.sum("cnt")).scalar())
        busy = F.col("reorganize") & (F.coalesce("cnt", F.lit(0)) > 0)
        last = last.withColumn("_last", F.when(
            busy, F.raise_error(F.lit("data in MAXVALUE partition exists")).cast("date")).otherwise(F.col("_last")))
    stop = F.lit(end).cast("date")
    # Steps start strictly before the end, so the last bound may pass it.
    starts = F.when(F.col("_last") < stop, F.sequence(F.col("_last").cast("date"), F.date_sub(stop, 1), step))
    if limit:
        starts = F.slice(starts, 1, limit)
    rows = last.select(*keys, "_n", "reorganize", F.posexplode(starts).alias("_i", "_from"))
    added = rows.select(
        *keys, F.concat(F.lit(prefix), (F.col("_n") + 1 + F.col("_i")).cast("string")).alias("name"),
        (F.col("_from").cast("timestamp") + step).cast("date").alias("bound"), "reorganize",
    )
    tail = rows.filter("reorganize").groupBy(*keys).agg(F.max(F.col("_n") + 2 + F.col("_i")).alias("_next"))
    tail = tail.select(
        *keys, F.concat(F.lit(prefix), F.col("_next").cast("string")).alias("name"),
        F.lit(None).cast("date").alias("bound"), F.lit(True).alias("reorganize"),
    )
    return added.unionByName(tail.filter("name is not null"))


def partitions_before(partitions: DataFrame, date, limit: int | None = None) -> DataFrame:
    """Partitions whose bound is before a date, oldest first; MAXVALUE is never one."""
    old = partitions.filter(F.col("bound").isNotNull() & (F.col("bound") < date))
    return old if limit is None else old.orderBy("bound").limit(limit)


def split_by_partitions(rows: DataFrame, dropped: DataFrame, partition: str = "partition") -> tuple[DataFrame, DataFrame]:
    """Rows to archive with the dropped partitions, and rows that stay."""
    names = dropped.select(F.col("name").alias(partition))
    return rows.join(names, partition, "left_semi"), rows.join(names, partition, "left_anti")


# --- retention and archives ----------------------------------------------------------


def purge_older(rows: DataFrame, ts: str, retention: str, now) -> DataFrame:
    """Rows not older than ``Nd/w/m/y`` before ``now``; rows without a time are kept."""
    cut = dates.retention_cutoff(retention, F.lit(now).cast("timestamp"))
    return rows.filter(F.col(ts).isNull() | (F.col(ts).cast("timestamp") >= cut))


def split_rows(rows: DataFrame, condition: str, limit: int | None = None, order=(), block: int = selection.BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows matching a condition (at most ``limit``, in order, NULLs first) and the rest.

    With a limit the rows are written once with a number each, so that equal rows
    and NULLs in the order are told apart: every row is on one side exactly. Where
    the limit falls is found by counting, so it may be as large as the table.
    """
    hit = F.coalesce(F.expr(condition), F.lit(False))
    if limit is None:
        return rows.filter(hit), rows.filter(~hit)
    numbered = lineage.written(rows.withColumn("_row", F.monotonically_increasing_id()), "archive")
    first = selection.cut(numbered.filter(hit).select(*dict.fromkeys(order), "_row"), [(o, False) for o in (*order, "_row")], F.lit(limit), block=block)
    picked = lineage.written(first.filter("inside").select("_row"), "archived")
    return numbered.join(picked, "_row", "left_semi").select(*rows.columns), numbered.join(picked, "_row", "left_anti").select(*rows.columns)


def archive_by_name_age(tables: DataFrame, name: str, pattern: str, retention: str, now) -> DataFrame:
    """Tables whose name carries a date older than the retention."""
    born = dates.age_from_name(name, pattern)
    cut = dates.retention_cutoff(retention, F.lit(now).cast("timestamp"))
    return tables.withColumn("born", born).filter(F.col("born") < cut)


def rotation_plan(tables: DataFrame, existing: DataFrame, name: str, date, pattern: str, keys: list[str] = ()) -> DataFrame:
    """Tables to rotate with their new name; those already rotated for the date are skipped."""
    plan = tables.withColumn("rotated", dates.rotated_name(name, date, pattern))
    have = existing.select(*keys, F.col(name).alias("rotated"))
    return plan.join(have, [*keys, "rotated"], "left_anti")


# --- pruning and merging --------------------------------------------------------------


def prune(parents: DataFrame, children: list[tuple[DataFrame, str]], key: str, keep: int, block: int = selection.BLOCK_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """Keep the first ``keep`` parents by key; children of dropped parents go, orphans stay.

    The cut is one key, found by counting ranges of keys. Parents of equal keys at the
    cut all stay; a parent without a key is no one's parent and stays too. With
    ``keep`` 0 every parent with a key goes.
    """
    if keep <= 0:
        kept, gone = parents.filter(F.col(key).isNull()), parents.filter(F.col(key).isNotNull())
    else:
        last = selection.kth(parents, key, keep, block).scalar()
        kept, gone = parents.filter(F.col(key).isNull() | (F.col(key) <= last)), parents.filter(F.col(key) > last)
    out = []
    for child, ref in children:
        dropped = gone.select(F.col(key).alias(ref)).distinct()
        out.append(child.join(dropped, ref, "left_anti").select(*child.columns))
    return kept, out


def children_by_column(columns: DataFrame, parent: str, key: str) -> DataFrame:
    """Tables having a column named like a parent's key (table_name, column_name rows)."""
    mine = columns.filter((F.col("table_name") == parent) & (F.col("column_name") == key)).select("column_name")
    return columns.filter(F.col("table_name") != parent).join(mine, "column_name", "left_semi")


def merge_sources(sources: list[DataFrame], key: list[str], on_conflict: str = "ignore") -> DataFrame:
    """Union of several copies of a table; on equal keys the first source wins, or the job fails.

    Of equal keys inside one source the least row stays. A row with a NULL in its key
    equals no other and is passed on. One partial aggregate per key, so a key repeated
    many times combines map side.
    """
    tagged = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    x = reduce(lambda a, b: a.unionByName(b), tagged)
    cols = sources[0].columns
    rest = [c for c in cols if c not in key]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    agg = x.filter(whole).groupBy(*key).agg(F.min(F.struct("_src", *rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    if on_conflict == "die":
        clash = F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*key)))).cast("bigint")
        agg = agg.withColumn("_n", F.when(F.col("_n") > 1, clash).otherwise(F.col("_n"))).filter("_n >= 0")
    elif on_conflict != "ignore":
        raise ValueError("on_conflict is 'ignore' or 'die'")
    return agg.select(*key, "_r.*").select(*cols).unionByName(x.filter(~whole).select(*cols))


def without_foreign_keys(tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Tables that are neither child nor parent of a foreign key."""
    child = foreign_keys.select("database_name", "table_name")
    parent = foreign_keys.select(
        F.col("referenced_database_name").alias("database_name"), F.col("referenced_table_name").alias("table_name")
    )
    return tables.join(child.union(parent).distinct(), ["database_name", "table_name"], "left_anti")


# --- upserts -----------------------------------------------------------------------------


def merge_review(review: DataFrame, seen: DataFrame, now) -> DataFrame:
    """Insert new classes and widen ``first_seen``/``last_seen`` of known ones.

    ``seen`` has checksum, fingerprint, sample, first_seen, last_seen; a missing
    time is ``now``. Reviewer, review time and comments stay.
    """
    at = F.lit(now).cast("timestamp")
    s = seen.select(
        "checksum", F.col("fingerprint").alias("_f"), F.col("sample").alias("_s"),
        F.coalesce("first_seen", at).alias("_first"), F.coalesce("last_seen", at).alias("_last"),
    )
    x = review.join(s, "checksum", "full_outer")
    return x.select(
        "checksum", F.coalesce("fingerprint", "_f").alias("fingerprint"), F.coalesce("sample", "_s").alias("sample"),
        F.least("first_seen", "_first").alias("first_seen"), F.greatest("last_seen", "_last").alias("last_seen"),
        "reviewed_by", "reviewed_on", "comments",
    )


def unreviewed(classes: DataFrame, review: DataFrame) -> DataFrame:
    """Classes nobody has reviewed yet."""
    done = review.filter("reviewed_by is not null").select("checksum")
    return classes.join(done, "checksum", "left_anti")


def apply_review_marks(review: DataFrame, marks: DataFrame) -> DataFrame:
    """Take over reviewer, comment and time of each class's newest mark, where it is not older than the review."""
    names = ("reviewed_by", "reviewed_on", "comments")
    newest = F.max(F.struct("reviewed_on", "reviewed_by", "comments")).alias("_m")
    x = review.join(marks.groupBy("checksum").agg(newest), "checksum", "left")
    newer = F.col("_m").isNotNull() & (F.col("reviewed_on").isNull() | F.coalesce(F.col("_m.reviewed_on") >= F.col("reviewed_on"), F.lit(False)))
    new = {c: F.when(newer, F.coalesce(f"_m.{c}", c)).otherwise(F.col(c)) for c in names}
    return x.withColumns(new).select(*review.columns)


def history_rows(metrics: DataFrame, checksum: str, attributes: list[str], ts_min: str, ts_max: str,
                 kinds=("cnt", "sum", "min", "max", "pct_95", "stddev", "median")) -> DataFrame:
    """Class metrics as wide history rows with ``<attribute>_<metric>`` columns."""
    wide = metrics.groupBy(checksum, ts_min, ts_max).pivot("attribute", attributes).agg(
        *[F.first(k).alias(k) for k in kinds]
    )
    # With one aggregate Spark leaves the metric out of the column name.
    if len(kinds) == 1:
        wide = wide.select(checksum, ts_min, ts_max, *[F.col(a).alias(f"{a}_{kinds[0]}") for a in attributes])
    return wide


def replace_history(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """History with rows of equal keys replaced; NULLs in keys are equal."""
    return _absent(history, rows, keys).unionByName(rows, allowMissingColumns=True)


def _absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known; NULLs are equal."""
    other = known.select(*[F.col(k).alias(f"_known_{k}") for k in keys])
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]), "left_anti")


def merge_hosts(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Host map upsert: (checksum, host, ip, type), first and last time seen."""
    keys = ["checksum", "host", "ip", "type"]
    both = known.select(*keys, "first_seen", "last_seen").unionByName(seen.select(*keys, "first_seen", "last_seen"))
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def host_rows(events: DataFrame, checksum: str, source_ip: str, destination_ip: str, ts: str) -> DataFrame:
    """One SOURCE and one DESTINATION observation per event."""
    sides = F.array(
        F.struct(F.col(source_ip).alias("host"), F.lit("SOURCE").alias("type")),
        F.struct(F.col(destination_ip).alias("host"), F.lit("DESTINATION").alias("type")),
    )
    return events.select(F.col(checksum).alias("checksum"), F.col(ts).alias("_t"), F.inline(sides)).groupBy(
        "checksum", "host", "type"
    ).agg(F.min("_t").alias("first_seen"), F.max("_t").alias("last_seen"))


def insert_if_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those new rows whose keys are not there yet; NULLs in keys are equal.

    Of new rows with equal keys the least one is inserted.
    """
    rest = [c for c in existing.columns if c not in keys]
    fresh = _absent(rows.select(*existing.columns), existing, keys)
    if rest:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    else:
        fresh = fresh.distinct()
    return existing.unionByName(fresh.select(*existing.columns))


def host_edges(hosts: DataFrame, checksum: str = "checksum") -> DataFrame:
    """Edges of the host -> query -> host graph: (from_node, to_node, kind), each once.

    A query's sources and destinations meet in its node, so the graph grows with
    the host map and not with sources times destinations.
    """
    is_source = F.col("type") == "SOURCE"
    return hosts.filter(F.col("type").isin("SOURCE", "DESTINATION")).select(
        F.when(is_source, F.col("host")).otherwise(F.col(checksum)).alias("from_node"),
        F.when(is_source, F.col(checksum)).otherwise(F.col("host")).alias("to_node"),
        F.lower("type").alias("kind"),
    ).distinct()


def with_latest_history(queries: DataFrame, history: DataFrame, key: str = "checksum", ts: str = "ts_max") -> DataFrame:
    """Each query beside its latest history row; queries without history are dropped."""
    rest = [c for c in history.columns if c != key]
    latest = history.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_h")).select(key, "_h.*")
    return queries.join(latest, key, "inner")


def jobs_report(jobs: DataFrame, queries: DataFrame, master: DataFrame, since, until, order: Column, n: int) -> DataFrame:
    """Stored jobs of a period with their top queries by a key."""
    x = jobs.filter((F.col("processed") >= since) & (F.col("processed") < until)).join(queries, "job_id").join(master, "query_id")
    w = Window.partitionBy("job_id").orderBy(order, "query_id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_by(df: DataFrame, order: str, n: int, tie: list[str] = ()) -> DataFrame:
    """First ``n`` rows by a descending sort key."""
    return df.orderBy(F.col(order).desc(), *tie).limit(n)
