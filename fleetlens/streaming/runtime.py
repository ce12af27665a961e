"""Where streams keep checkpoints and outputs, and how they are run to the end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fleetlens.operators.lineage import shared_dir  # noqa: F401


def append_batches(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch as Parquet under its batch id; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )


@contextmanager
def timed_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which typed state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last row written for each key of an update-mode stream."""
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


class LateRows(StreamingQueryListener):
    """Counts the rows of every query that came after its watermark, from the first batch on."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        ident = str(event.progress.id)
        self.dropped[ident] = self.dropped.get(ident, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.id), 0)
