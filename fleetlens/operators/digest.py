"""Event classes and their statistics.

The aggregate is taken wide (one row per class, several columns per attribute)
and unpivoted afterwards, so events are never multiplied by attributes before
the shuffle. Global figures are sums over the class rows, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import histogram as hist
from fleetlens.operators import lineage, ordered, selection


def _wide(df: DataFrame, keys: list[str], numeric, text, boolean) -> DataFrame:
    aggs = []
    for a in numeric:
        v = F.col(a).cast("double")
        aggs += [F.count(v).alias(f"{a}|cnt"), F.sum(v).alias(f"{a}|sum"),
                 F.min(v).alias(f"{a}|min"), F.max(v).alias(f"{a}|max")]
    for a in boolean:
        v = F.when(F.col(a) == "Yes", 1.0).when(F.col(a).isNotNull(), 0.0)
        aggs += [F.count(v).alias(f"{a}|cnt"), F.sum(v).alias(f"{a}|sum"),
                 F.min(v).alias(f"{a}|min"), F.max(v).alias(f"{a}|max")]
    for a in text:
        v = F.col(a).cast("string")
        aggs += [F.count(v).alias(f"{a}|cnt"), F.min(v).alias(f"{a}|tmin"), F.max(v).alias(f"{a}|tmax")]
    return df.groupBy(*keys).agg(*aggs)


def _unpivot(wide: DataFrame, keys: list[str], numeric, text, boolean) -> DataFrame:
    rows = []
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for kind, names in (("num", numeric), ("bool", boolean), ("string", text)):
        for a in names:
            is_text = kind == "string"
            rows.append(F.struct(
                F.lit(a).alias("attribute"), F.lit(kind).alias("type"),
                F.col(f"{a}|cnt").alias("cnt"),
                (none if is_text else F.col(f"{a}|sum")).alias("sum"),
                (none if is_text else F.col(f"{a}|min")).alias("min"),
                (none if is_text else F.col(f"{a}|max")).alias("max"),
                (F.col(f"{a}|tmin") if is_text else no_text).alias("text_min"),
                (F.col(f"{a}|tmax") if is_text else no_text).alias("text_max"),
            ))
    return wide.select(*keys, F.inline(F.array(*rows))).filter("cnt > 0")


def digest(events: DataFrame, group_by: list[str], numeric=(), text=(), boolean=()) -> DataFrame:
    """One row per class and attribute: cnt, sum, min, max (text: by text order)."""
    wide = _wide(events, group_by, numeric, text, boolean)
    return _unpivot(wide, group_by, numeric, text, boolean)


def rewritten_classes(events: DataFrame, raw: str, rewrite, name: str, group_by: list[str] = (), sums: dict[str, str] | None = None) -> DataFrame:
    """``cnt`` and sums per class, where the class is a dear rewrite of a text.

    Equal texts are counted first, map side, and meet by their hash; each is then
    rewritten once, in parallel however few files the events come from.
    """
    sums = sums or {}
    by_text = events.groupBy(raw, *group_by).agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
    classes = by_text.select(rewrite(F.col(raw)).alias(name), *group_by, "cnt", *sums)
    return classes.groupBy(name, *group_by).agg(F.sum("cnt").alias("cnt"), *[F.sum(n).alias(n) for n in sums])


def rewritten_digest(events: DataFrame, raw: str, rewrite, name: str, numeric: list[str]) -> DataFrame:
    """``digest`` of numeric attributes by a class that is a dear rewrite of a text, in the same two steps."""
    wide = _wide(events, [raw], numeric, (), ()).withColumn(name, rewrite(F.col(raw)))
    parts = {"cnt": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    whole = wide.groupBy(name).agg(*[fn(f"{a}|{part}").alias(f"{a}|{part}") for a in numeric for part, fn in parts.items()])
    return _unpivot(whole, [name], numeric, (), ())


def globals_of(classes: DataFrame) -> DataFrame:
    """The same figures over all classes, from the class rows."""
    return classes.groupBy("attribute", "type").agg(
        F.sum("cnt").alias("cnt"), F.sum("sum").alias("sum"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.min("text_min").alias("text_min"), F.max("text_max").alias("text_max"),
    )


def infer_types(df: DataFrame, names: list[str]) -> DataFrame:
    """``num``, ``bool`` or ``string`` per attribute, over all its values."""
    number = r"\A[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
    out = []
    for n in names:
        v = F.col(n).cast("string")
        kind = (
            F.when(F.count(v) == 0, F.lit(None).cast("string"))
            .when(F.bool_and(v.rlike(number)), F.lit("num"))
            .when(F.bool_and(v.rlike(r"\A(?:Yes|No)\z")), F.lit("bool"))
            .otherwise(F.lit("string"))
        )
        out.append(kind.alias(n))
    one = df.agg(*out)
    pairs = [F.struct(F.lit(n).alias("attribute"), F.col(n).alias("type")) for n in names]
    return one.select(F.inline(F.array(*pairs)))


def unroll(events: DataFrame, array_col: str, element: str) -> DataFrame:
    """One event per element of an array attribute, to group by the element."""
    rest = [F.col(c) for c in events.columns if c not in (array_col, element)]
    return events.select(*rest, F.explode(array_col).alias(element))


def digest_groupings(events: DataFrame, groupings: list[str], value: str) -> DataFrame:
    """Several independent single-column groupings of one numeric attribute in one pass."""
    view = events.select(*groupings, F.col(value).cast("double").alias("_v"))
    name = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in groupings])
    key = F.coalesce(*[F.when(F.grouping(g) == 0, F.col(g).cast("string")) for g in groupings])
    grouped = view.groupingSets([[F.col(g)] for g in groupings], *[F.col(g) for g in groupings])
    return grouped.agg(
        name.alias("grouping"), key.alias("class"),
        F.count("_v").alias("cnt"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"),
    ).select("grouping", "class", "cnt", "sum", "min", "max")


def class_statistics(events: DataFrame, group_by: list[str], numeric: list[str]) -> DataFrame:
    """cnt, sum, min, max, avg, pct_95, median, stddev per class and attribute, in one pass."""
    return hist.summarize(hist.buckets(events, group_by, numeric), [*group_by, "attribute"])


def metrics(events: DataFrame, group_by: list[str], numeric: list[str]) -> DataFrame:
    """The metrics row of each class and attribute: cnt, pct, sum, min, max, avg, median, pct_95, stddev.

    Events are read once: their histogram rows are written, and both the class
    figures and the global count behind ``pct`` come from these.
    """
    rows = lineage.written(hist.buckets(events, group_by, numeric), "metrics")
    counts = rows.groupBy("attribute").agg(F.sum("n").alias("n"))
    everything = counts.agg(F.map_from_entries(F.collect_list(F.struct("attribute", "n")))).scalar()
    x = hist.summarize(rows, [*group_by, "attribute"]).withColumn("_all", everything)
    return x.select(
        *group_by, "attribute", "cnt", (F.col("cnt") / F.col("_all")[F.col("attribute")]).alias("pct"),
        "sum", "min", "max", "avg", "median", "pct_95", "stddev", "cutoff",
    )


def value_counts(events: DataFrame, group_by: list[str], attributes: list[str]) -> DataFrame:
    """Occurrences of each value of text attributes, per class."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    return (
        events.select(*group_by, F.inline(pairs)).filter("value is not null")
        .groupBy(*group_by, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def top_values_text(counts: DataFrame, keys: list[str], max_value: int = 10, width: int = 47) -> DataFrame:
    """Most frequent values as one line: ``a (3), b (1)... 2 more``, per key.

    Only as many values can be printed as fit the line, so a top-k per key is
    taken before anything is collected; the rest is counted, not gathered.
    """
    per_key = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("uniq"), F.first("value").alias("_only"))
    fit = width // 5 + 1
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value"))
    short = F.when(
        F.length("value") > max_value, F.concat(F.substring("value", 1, max_value), F.lit("..."))
    ).otherwise(F.col("value"))
    top = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= fit).withColumn("_p", short)
    item = F.concat(F.col("_p"), F.lit(" ("), F.col("n").cast("string"), F.lit("), "))
    before = F.coalesce(F.sum(F.length(item)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("_item", item).withColumn("_over", F.when(before + F.length("_p") > width, 1).otherwise(0))
    # Stop at the first value that does not fit, even if a later one would.
    top = top.withColumn("_stop", F.sum("_over").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = top.filter("_stop = 0").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_r", "_item"))).alias("_items"), F.count(F.lit(1)).alias("_shown")
    )
    text = F.regexp_replace(F.array_join(F.transform("_items", lambda i: i["_item"]), ""), r", \z", "")
    text = F.coalesce(text, F.lit(""))
    shown = F.coalesce(F.col("_shown"), F.lit(0))
    more = F.when(
        shown < F.col("uniq"), F.concat(F.lit("... "), (F.col("uniq") - shown).cast("string"), F.lit(" more"))
    ).otherwise(F.lit(""))
    single = F.when(
        F.length("_only") > width - 3, F.concat(F.substring("_only", 1, width - 3), F.lit("..."))
    ).otherwise(F.col("_only"))
    return per_key.join(line, keys, "left").select(
        *keys, "uniq", F.when(F.col("uniq") == 1, single).otherwise(F.concat(text, more)).alias("top"),
    )


def worst_samples(events: DataFrame, group_by: list[str], worst: str, sample: list[str], pos: str) -> DataFrame:
    """The event with the largest ``worst`` value of each class, the last on ties."""
    row = F.struct(*sample)
    rank = F.struct(F.coalesce(F.col(worst).cast("double"), F.lit(float("-inf"))), F.col(pos))
    return events.groupBy(*group_by).agg(F.max_by(row, rank).alias("_s")).select(
        *group_by, *[F.col(f"_s.{c}").alias(c) for c in sample]
    )


def rates(events: DataFrame, group_by: list[str], value: str, ts: str) -> DataFrame:
    """Events per second and concurrency over the span of each class; 0 for an empty span."""
    span = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(1e6)
    agg = events.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(value).alias("sum"), span.alias("seconds")
    )
    zero = F.lit(0.0)
    return agg.select(
        *group_by, "cnt", "sum", "seconds",
        F.when(F.col("seconds") > 0, F.col("cnt") / F.col("seconds")).otherwise(zero).alias("qps"),
        F.when(F.col("seconds") > 0, F.col("sum") / F.col("seconds")).otherwise(zero).alias("concurrency"),
    )


def timeline(events: DataFrame, group_by: list[str], value: str, ts: str, order: list[str], block: Column) -> DataFrame:
    """Runs of events with an equal key in log order, with start and duration."""
    out = ordered.runs(
        events, group_by, order, block,
        aggregates={"cnt": ("count", value), "sum": ("sum", value), "min": ("min", value),
                    "max": ("max", value), "ts_min": ("min", ts), "ts_max": ("max", ts)},
    )
    seconds = (F.unix_micros(F.col("ts_max").cast("timestamp")) - F.unix_micros(F.col("ts_min").cast("timestamp"))) / F.lit(1e6)
    return out.withColumn("seconds", seconds)


def top_classes(classes: DataFrame, order_by: str, class_id: str, total_limit: float | None = None,
                count_limit: int | None = None, pct_of: Column | None = None,
                outlier: Column | None = None, block: int = selection.BLOCK_ROWS) -> DataFrame:
    """Classes of a report with their ``rank`` and ``reason``.

    A class is ``top`` while the total before it is under ``total_limit`` (or
    under ``pct_of``, a per-row column) and fewer than ``count_limit`` precede
    it; otherwise ``outlier`` when that column holds. With a count limit only
    that many classes are ever ordered (a top-k); without one the place where
    the total is reached is found by counting, and ``block`` classes at most are
    sorted, however many have one metric. ``classes`` is read several times.
    """
    ranked = classes.filter(F.col(order_by).isNotNull())
    order = [F.col(order_by).desc(), F.col(class_id)]
    limit = pct_of if pct_of is not None else F.lit(total_limit)
    no_limit = total_limit is None and pct_of is None
    if count_limit:
        head = ranked.orderBy(*order).limit(count_limit)
        w = Window.partitionBy(F.lit(0)).orderBy(*order)
        before = F.coalesce(F.sum(order_by).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        head = head.withColumn("_before", before)
        top = head if no_limit else head.filter((F.col("_before") < limit) | (limit == 0))
        chosen = top.select(class_id).withColumn("_top", F.lit(True))
        marked = ranked.join(chosen, class_id, "left")
        is_top = F.coalesce(F.col("_top"), F.lit(False))
    elif no_limit:
        marked, is_top = ranked, F.lit(True)
    else:
        marked = selection.cut(ranked, [(order_by, True), (class_id, False)], limit, weight=F.col(order_by), block=block)
        is_top = F.coalesce(F.col("inside"), F.lit(False)) | (limit == 0)
    reason = F.when(is_top, F.lit("top"))
    if outlier is not None:
        reason = reason.when(outlier, F.lit("outlier"))
    out = marked.withColumn("reason", reason).filter("reason is not null")
    return out.select(*classes.columns, "reason")


def ranked_report(chosen: DataFrame, order_by: str, class_id: str) -> DataFrame:
    """Rank of each reported class and its share of the reported total.

    Runs over the selected classes, whose number the report's limits bound.
    """
    everything = Window.partitionBy(F.lit(0))
    w = everything.orderBy(F.col(order_by).desc(), F.col(class_id))
    return chosen.select(
        F.row_number().over(w).alias("rank"), *chosen.columns,
        (F.col(order_by) / F.sum(order_by).over(everything) * 100).alias("pct_reported"),
    )


def order_attribute(columns: list[str], wanted: str, fallback: str = "Query_time") -> str:
    """The sort attribute, or the fallback (then the count) when the data lacks it."""
    for name in (wanted, fallback):
        if name in columns:
            return name
    return "cnt"


def trimmed_statistics(events: DataFrame, group_by: list[str], value: str, percent: int, block: int = selection.BLOCK_ROWS) -> DataFrame:
    """Sum, avg, min and max of the lowest ``floor(n*p/100)`` values of each class.

    Equal values are counted first. Where the share of a class ends is found by
    counting ranges of the value, however narrow they are, and only the values
    of one range, ``block`` at most, are sorted.
    """
    v = F.col(value).cast("double")
    counted = events.filter(v.isNotNull()).groupBy(*group_by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = lineage.written(counted, "trimmed")
    keep = F.floor(F.col("_total") * percent / 100)
    ranked = selection.cut(counted, [("_v", False)], keep, group_by, F.col("_n"), block).filter("inside")
    used = F.least(F.col("_n"), F.coalesce("room", "_n"))
    return (
        ranked.withColumn("_used", used).groupBy(*group_by)
        .agg(
            F.sum("_used").alias("cnt"), F.sum(F.col("_used") * F.col("_v")).alias("sum"),
            (F.sum(F.col("_used") * F.col("_v")) / F.sum("_used")).alias("avg"),
            F.min("_v").alias("min"), F.max("_v").alias("max"),
        )
    )


def value_distribution(events: DataFrame, group_by: list[str], value: str, min_percent: float, max_lines: int) -> DataFrame:
    """Share of each value, those of at least ``min_percent``, at most ``max_lines`` per class."""
    counts = events.groupBy(*group_by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group_by).agg(F.sum("n").alias("_all"))
    w = Window.partitionBy(*group_by).orderBy(F.col("n").desc(), F.col(value))
    return (
        counts.join(totals, group_by)
        .withColumn("pct", F.col("n") * 100 / F.col("_all")).drop("_all")
        .filter(F.col("pct") >= min_percent)
        .withColumn("line", F.row_number().over(w)).filter(F.col("line") <= max_lines)
    )


def class_summary(events: DataFrame, group_by: list[str], measures: list[str], first: list[str], pos: str) -> DataFrame:
    """Count, min/max/sum/avg of measures, and first values by position, per class."""
    aggs = [F.count(F.lit(1)).alias("c")]
    for m in measures:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.sum(m).alias(f"{m}_sum"), F.avg(m).alias(f"{m}_avg")]
    aggs += [F.min_by(f, pos).alias(f"first_{f}") for f in first]
    return events.groupBy(*group_by).agg(*aggs)


def value_share(events: DataFrame, group_by: list[str], value: str) -> DataFrame:
    """Share of a class's events by each value (user share)."""
    counts = events.groupBy(*group_by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group_by).agg(F.sum("n").alias("_all"))
    return counts.join(totals, group_by).withColumn("pct", F.col("n") * 100 / F.col("_all")).drop("_all")


def grouped_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Counts by columns; an unknown column is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def sample_moments(df: DataFrame, group_by: list[str], value: str) -> DataFrame:
    """Mean, sample variance and sample deviation (NULL for one value)."""
    return df.groupBy(*group_by).agg(
        F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("stddev")
    )


def table_access(statements: DataFrame, rw: str, tables: str, order: list[str]) -> DataFrame:
    """``read``/``write`` and table, each table once, as first used."""
    flat = statements.filter(F.col(rw).isNotNull()).select(F.col(rw).alias("access"), *order, F.posexplode(tables).alias("_i", "table"))
    return flat.groupBy("table").agg(F.min_by("access", F.struct(*order, "_i")).alias("access"))


def outlier_test(cnt, pct_95, freq: int, value: float) -> Column:
    """``cnt >= freq`` and ``pct_95 >= value``."""
    return (F.col(cnt) >= freq) & (F.col(pct_95) >= value)
