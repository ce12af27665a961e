"""Live process sessions and per-batch work: checks, samples and merges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.operators import checks, lifecycle, lineage, processes
from fleetlens.sources.buckets import BucketTable

SESSION_SCHEMA = "server string, id long, arg string, first_seen long, Query_time double, samples long"


class SessionProcessor(StatefulProcessor):
    """Per server: the samples of ticks that may still grow, and the open statement of each connection."""

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "tick long", "samples string")
        self.open = handle.getMapState("open", "id long", "info string, now long, time double, etime double, n long")
        self.passed = handle.getValueState("passed", "tick long")

    def _last(self) -> int:
        return self.passed.get()[0] if self.passed.exists() else -1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, found = self._last(), {}
        for part in rows:
            for now, ident, time, etime, info in part[["now", "id", "time", "etime", "info"]].itertuples(index=False):
                if now > last:
                    found.setdefault(int(now), []).append((int(ident), None if pd.isna(time) else float(time), 0.0 if pd.isna(etime) else float(etime), info or None))
        for tick, samples in found.items():
            if self.pending.containsKey((tick,)):
                samples = json.loads(self.pending.getValue((tick,))[0]) + samples
            else:
                # A tick is whole when the watermark has come to it; timers go off when it is beyond them.
                self.handle.registerTimer(tick // 1000 - 1)
            self.pending.updateValue((tick,), (json.dumps(samples),))
        yield pd.DataFrame([], columns=SESSION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, out = self._last(), []
        if last // 1000 - 1 < expiredTimerInfo.getExpiryTimeInMs():
            ready = sorted(t[0] for t in self.pending.keys() if t[0] // 1000 <= timerValues.getCurrentWatermarkInMs())
            before = {i[0]: v for i, v in self.open.iterator()}
            now_open = dict(before)
            for tick in ready:
                self._tick(key[0], tick, json.loads(self.pending.getValue((tick,))[0]), now_open, out)
                self.pending.removeKey((tick,))
            for ident in before.keys() - now_open.keys():
                self.open.removeKey((ident,))
            for ident, head in now_open.items():
                if before.get(ident) != head:
                    self.open.updateValue((ident,), head)
            if ready:
                self.passed.update((ready[-1],))
        yield pd.DataFrame(out, columns=SESSION_COLUMNS)

    @staticmethod
    def _tick(server, now, samples, open_, out) -> None:
        """One tick of a server: whoever is not seen as before is finished."""
        shown = {ident: (time, etime, info) for ident, time, etime, info in samples if info and time is not None}
        for ident in list(open_):
            info, first, head_time, head_etime, n = open_[ident]
            time, etime, text = shown.get(ident, (None, None, None))
            goes_on = text == info and time >= head_time and processes.latest_start(now, time, etime) <= processes.start_of(first, head_time, head_etime)
            if goes_on:
                open_[ident] = (info, first, head_time, head_etime, n + 1)
                del shown[ident]
            else:
                out.append((server, ident, info, first, max(head_time, (now - first) / 1e6), n))
                del open_[ident]
        for ident, (time, etime, text) in shown.items():
            open_[ident] = (text, now, time, etime, 1)


SESSION_COLUMNS = ["server", "id", "arg", "first_seen", "Query_time", "samples"]


def live_sessions(samples: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Finished statements from a stream of samples, as ``processes.sessions`` finds them in a table.

    State is kept per server: the open statement of each connection, and the samples of
    ticks that the watermark has not reached. A tick of a server closes what it does not
    show any more. A sample that comes after its tick was passed is late and left out.
    Queries with it need the RocksDB state store (``runtime.timed_state``).
    """
    at = F.col("ts").cast("timestamp")
    x = samples.select(
        F.col("server").cast("string").alias("server"), F.col("id").cast("long").alias("id"), at.alias("ts"), F.unix_micros(at).alias("now"),
        F.col("time").cast("double").alias("time"), F.col("etime").cast("double").alias("etime"), "info",
    ).filter("ts is not null").withWatermark("ts", lateness)
    out = x.groupBy("server").transformWithStateInPandas(SessionProcessor(), SESSION_SCHEMA, "Append", "EventTime")
    return out.withColumn("first_seen", F.timestamp_micros("first_seen"))


class FirstProcessor(StatefulProcessor):
    """Per class: how many rows were passed on so far."""

    def __init__(self, n: int, order: list[str], columns: list[str]):
        self.n, self.order, self.columns = n, order, columns

    def init(self, handle) -> None:
        self.passed = handle.getValueState("passed", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        room = self.n - (self.passed.get()[0] if self.passed.exists() else 0)
        first = None
        for part in rows if room > 0 else ():
            both = part if first is None else pd.concat([first, part])
            first = both.sort_values(self.order, kind="stable").head(room)
        if first is not None and len(first):
            self.passed.update((self.n - room + len(first),))
            yield first[self.columns]
        else:
            yield pd.DataFrame([], columns=self.columns)


def stream_first(stream: DataFrame, class_col: str, n: int, order: list[str], held: int = 100_000) -> DataFrame:
    """The first ``n`` rows of each class of a stream, by batch and, within one, by ``order``.

    A task hands on at most ``n`` rows of a class for every ``held`` rows it keeps, so a
    class that is most of a batch is cut down before the exchange; the state is a number
    per class, and no earlier row is read again.
    """
    columns = stream.columns

    def run(batches):
        kept = None
        for batch in batches:
            part = batch.to_pandas()
            kept = part if kept is None else pd.concat([kept, part])
            kept = kept.sort_values(order, kind="stable").groupby(class_col, dropna=False, sort=False).head(n)
            if len(kept) > held:
                yield pa.RecordBatch.from_pandas(kept, schema=batch.schema, preserve_index=False)
                kept = None
        if kept is not None and len(kept):
            yield pa.RecordBatch.from_pandas(kept, schema=batch.schema, preserve_index=False)

    cut = stream.mapInArrow(run, stream.schema)
    return cut.groupBy(class_col).transformWithStateInPandas(FirstProcessor(n, order, columns), stream.schema, "Append", "None")


def watch_batches(watches: DataFrame, keys: list[str], on_fail: Callable[[DataFrame, int], None], require_all: bool = False):
    """A ``foreachBatch`` function that runs the batch check and hands failing ticks on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        failing = checks.watch(batch, watches, keys, require_all).filter("failed")
        on_fail(failing, batch_id)

    return run


def alert_batches(watches: DataFrame, keys: list[str], folder: str, require_all: bool = False):
    """A ``foreachBatch`` function that keeps the failing ticks of each batch under ``folder``; a repeated batch replaces its own."""
    return watch_batches(watches, keys, lambda failing, batch_id: failing.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}"), require_all)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts that were kept, each with its batch."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch_id=*")


def late_batches(folder: str, ts: str, interval: str, lateness: str, then: Callable[[DataFrame, int], None] | None = None):
    """A ``foreachBatch`` function that keeps rows whose window was closed when they came.

    The watermark of a batch is the latest time of the batches before it less the
    lateness, as Structured Streaming has it; it is written beside the rows, under the
    batch's number, so a repeated batch sees the same one. ``then`` gets the rows in time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col(ts).cast("timestamp")
        before = None
        if batch_id > 0:
            before = spark.read.schema("latest long").parquet(f"{folder}/latest/batch_id={batch_id - 1}").first()[0]
        latest = batch.agg(F.max(F.unix_micros(at)).alias("latest")).select(F.greatest("latest", F.lit(before).cast("long")).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{folder}/latest/batch_id={batch_id}")
        mark = F.timestamp_micros(F.lit(before).cast("long")) - F.expr(f"interval {lateness}")
        # A window has no place for rows without a time and would lose them; they are never late.
        end = F.window(F.coalesce(at, F.timestamp_seconds(F.lit(0))), interval)["end"]
        late = F.coalesce(at.isNotNull() & (end <= mark), F.lit(False))
        batch.withColumn("_late", late).filter("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
        if then:
            then(batch.withColumn("_late", late).filter("not _late").drop("_late"), batch_id)

    return run


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that came too late, each with its batch."""
    return spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late/batch_id=*")


def merge_batches(table: BucketTable, now, summarize: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function merging each batch into a review table by ``checksum``; it rewrites the buckets the batch touches."""

    def run(batch: DataFrame, batch_id: int) -> None:
        seen = lineage.written(summarize(batch), "seen")
        table.merge(seen, f"batch {batch_id}", lambda old, new: lifecycle.merge_review(old, new, now).select(*old.columns))

    return run


def merge_host_batches(table: BucketTable, observe: Callable[[DataFrame], DataFrame]):
    """The same for the host map, by its keys."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(lineage.written(observe(batch), "seen"), f"batch {batch_id}", lifecycle.merge_hosts)

    return run
