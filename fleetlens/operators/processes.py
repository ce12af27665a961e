"""Process-list samples: selection, counts and sessions of running statements."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators import ordered

# --- Fixed values: process states counted by name; all others are ``other``. -----
KNOWN_STATES = (
    "closing_tables", "copying_to_tmp_table", "end", "freeing_items", "init",
    "locked", "login", "preparing", "reading_from_net", "sending_data",
    "sorting_result", "statistics", "updating", "writing_to_net", "none",
)
PROCESS_FIELDS = ("user", "host", "db", "command", "state")
# -----------------------------------------------------------------------------------


def log_rows(samples: DataFrame, server, event_time) -> DataFrame:
    """Observation rows ready to append: server, time, lower-case command and state."""
    at = F.lit(event_time).cast("timestamp") if not isinstance(event_time, Column) else event_time
    name = F.lit(server) if isinstance(server, str) else server
    return samples.withColumns({
        "server": name, "event_time": at, "command": F.lower("command"), "state": F.lower("state"),
        "event_date": F.to_date(at),
    })


def find_processes(df: DataFrame, match: dict[str, str] | None = None, ignore: dict[str, str] | None = None,
                   busy_time: float | None = None, idle_time: float | None = None, only_oldest: bool = False) -> DataFrame:
    """Rows passing every given test, with at least one positive test met."""
    def field(name: str, pattern) -> Column:
        col = F.col(name)
        hit = (col == pattern) if name == "id" else col.rlike(str(pattern))
        return F.coalesce(hit, F.lit(False))

    command = F.coalesce(F.col("command"), F.lit(""))
    keep, positive = F.lit(True), F.lit(False)
    for kind, bound in (("Query", busy_time), ("Sleep", idle_time)):
        if bound:
            concerned = command == kind
            keep = keep & (~concerned | (F.col("time") >= bound))
            positive = positive | concerned
    for name, pattern in (ignore or {}).items():
        keep = keep & ~field(name, pattern)
    for name, pattern in (match or {}).items():
        keep = keep & field(name, pattern)
        positive = F.lit(True)
    out = df.filter(keep & positive)
    ties = [c for c in ("server", "id") if c in df.columns]
    return out.orderBy(F.col("time").desc(), *ties).limit(1) if only_oldest else out


def counts_by_field(df: DataFrame, fields=PROCESS_FIELDS, extra: list[str] = ()) -> DataFrame:
    """Count and total time for each value of each field, in one pass over the rows."""
    label = {
        "command": F.lower(F.col("command")), "state": F.lower(F.col("state")),
        "host": F.regexp_replace("host", r":.*\z", ""),
    }
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.coalesce(label.get(f, F.col(f)).cast("string"), F.lit("NULL")).alias("value"))
        for f in fields
    ])
    return df.select(*extra, "time", F.inline(pairs)).groupBy(*extra, "field", "value").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.coalesce("time", F.lit(0))).alias("time")
    )


def state_counts(df: DataFrame, keys: list[str], known=KNOWN_STATES) -> DataFrame:
    """One column per known state, all others together, zero where absent."""
    state = F.lower(F.regexp_replace(
        F.when(F.col("state").isNull(), "NULL").when(F.col("state") == "", "none").otherwise(F.col("state")), " ", "_"
    ))
    s = F.when(state.isin(*known), state).otherwise(F.lit("other"))
    return df.select(*keys, s.alias("_s")).groupBy(*keys).agg(
        *[F.count_if(F.col("_s") == k).alias(f"State_{k}") for k in (*known, "other")]
    )


#: Microseconds by which a statement's start may drift: with whole seconds, and with fractions.
DRIFT_WHOLE, DRIFT_FRACTION = 1_000_000, 1_000


def start_of(now: int, time: float, etime: float) -> int:
    """Where a statement that a sample shows began, as the samples after it are measured against."""
    return (now - round(time * 1e6)) // 1_000_000 * 1_000_000 + round(etime * 1e6)


def latest_start(now: int, time: float, etime: float) -> int:
    """A sample goes on with a statement unless this is later than its start, or its time has gone back."""
    return now - round(time * 1e6) - round(etime * 1e6) - (DRIFT_WHOLE if time == int(time) else DRIFT_FRACTION)


def _grouped(batches, width: int):
    """Rows of sorted batches by their first ``width`` values: a key and its rows, a block at most."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def _block_heads(rows):
    """What a block of a run does to a statement that comes into it, and the statements that begin in it.

    ``rows`` are (now, time, etime, end, ...) in order. A statement that comes in goes on
    up to the first row whose time is less than its own or whose start is later; only a
    row below or beyond all before it can be that one, so these are kept with their
    values, and each is followed as a statement of its own up to where it ends.
    """
    heads, live, least, latest = {}, {}, [], []
    for at, (now, time, etime, *_) in enumerate(rows):
        late = latest_start(now, time, etime)
        broken = [h for h, (t, start) in live.items() if time < t or late > start]
        first = False
        if not least or time < least[-1][1]:
            least.append((at, time))
            first = True
        if not latest or late > latest[-1][1]:
            latest.append((at, late))
            first = True
        for h in broken:
            heads[h][1] = at
            del live[h]
        if first or broken:
            heads[at] = [at, -1, *rows[at]]
            live[at] = (time, start_of(now, time, etime))
    return list(heads.values()), least, latest


def sessions(samples: DataFrame, block_seconds: int = 86400) -> DataFrame:
    """Finished statements from process samples ``(server, ts, id, time, info, etime, ...)``.

    A statement ends when its text changes or vanishes, the connection is gone
    at the next sample, its time goes back, or its start drifts by more than
    the margin. Its time is at least as long as it was seen. Statements still
    there at the last sample are left out.

    Breaks between neighbours are found by windows over bounded blocks. Breaks
    against the first row of a statement, which may be far back, are found from
    summaries: the rows of a block stream by once, whatever comes into it, and one
    row per block is then passed in order with the statement that is open.
    """
    keys = ["server", "id"]
    tick = samples.select("server", "ts").distinct()
    block = ordered.time_block("ts", block_seconds)
    ticks = ordered.previous(tick, ["ts"], ["ts"], block, ["server"], "before_")
    ticks = ordered.following(ticks, ["ts"], ["ts"], block, ["server"], "after_").withColumnsRenamed({"before_ts": "tick_before", "after_ts": "tick_after"})
    live = samples.filter("info is not null and info <> '' and time is not null").join(ticks, ["server", "ts"])

    def broken(before: Column, row: Column) -> Column:
        return ~(before["ts"].eqNullSafe(row["tick_before"]) & before["info"].eqNullSafe(row["info"]))

    live = ordered.islands(live, ["ts", "info", "tick_before"], broken, ["ts"], block, keys, "_run")
    fields = [c for c in ("user", "host", "db") if c in samples.columns]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    names = [*keys, "_run", "_block"]
    rows = live.select(
        *keys, "_run", block.alias("_block"), micros("ts").alias("now"), F.col("time").cast("double").alias("time"),
        F.coalesce(F.col("etime").cast("double"), F.lit(0.0)).alias("etime"), micros("tick_after").alias("after"), "info", *fields,
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{c}`:{kinds[c]}" for c in ("now", "time", "etime", "after", "info", *fields))
    summary = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", n long, after long, heads array<struct<at:int,next:int,{head}>>, least array<struct<at:int,time:double>>, latest array<struct<at:int,start:bigint>>"
    found = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + ", ".join(f"`{c}` {kinds[c]}" for c in ("now", "time", "info", *fields)) + ", ended long, n long"
    summary_schema, found_schema = (to_arrow_schema(T.StructType.fromDDL(s)) for s in (summary, found))

    def batch(rows, schema):
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def summarised(batches):
        out = []
        for key, rows in _grouped(batches, len(names)):
            heads, least, latest = _block_heads(rows)
            as_rows = [dict(zip(("at", "next", "now", "time", "etime", "after", "info", *fields), h)) for h in heads]
            out.append((*key, len(rows), rows[-1][3], as_rows, [{"at": a, "time": v} for a, v in least], [{"at": a, "start": v} for a, v in latest]))
            if len(out) >= 1000:
                yield batch(out, summary_schema)
                out = []
        yield batch(out, summary_schema)

    def passed(batches):
        out, run, open_ = [], None, None  # open_: the statement's head, its rows so far, the tick after the last

        def done(head, n, ended):
            if ended is not None:
                out.append((*run[:2], head["now"], head["time"], head["info"], *(head[f] for f in fields), ended, n))

        for b in batches:
            for *key, _, n, after, heads, least, latest in zip(*(c.to_pylist() for c in b.columns)):
                if key != run:
                    if open_:
                        done(*open_)
                    run, open_, at = key, None, 0
                else:
                    start = start_of(open_[0]["now"], open_[0]["time"], open_[0]["etime"])
                    at = min([x["at"] for x in least if x["time"] < open_[0]["time"]][:1] + [x["at"] for x in latest if x["start"] > start][:1], default=-1)
                    if at < 0:
                        open_ = (open_[0], open_[1] + n, after)
                        continue
                by_place = {h["at"]: h for h in heads}
                if open_:
                    done(open_[0], open_[1] + at, by_place[at]["now"])
                while by_place[at]["next"] >= 0:
                    done(by_place[at], by_place[at]["next"] - at, by_place[by_place[at]["next"]]["now"])
                    at = by_place[at]["next"]
                open_ = (by_place[at], n - at, after)
            if len(out) >= 5000:
                yield batch(out, found_schema)
                out.clear()
        if open_:
            done(*open_)
        yield batch(out, found_schema)

    blocks = rows.repartition(*names).sortWithinPartitions(*names, "now").mapInArrow(summarised, summary)
    ended = blocks.repartition(*keys, "_run").sortWithinPartitions(*names).mapInArrow(passed, found)
    now, time = F.col("now") / F.lit(1e6), F.col("time")
    return ended.select(
        *keys, *fields, F.col("info").alias("arg"), F.length("info").alias("bytes"),
        F.timestamp_seconds(F.floor(now - time) + time).alias("end_ts"),
        F.greatest(time, (F.col("ended") - F.col("now")) / F.lit(1e6)).alias("Query_time"), F.timestamp_micros("now").alias("first_seen"), F.col("n").alias("samples"),
    )
