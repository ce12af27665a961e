"""Tables of hash buckets that are replaced in part, in one step.

A table is a folder with ``data/<version>/bucket=<n>`` and ``manifests/<number>``. A
manifest lists for every bucket the version that holds it; the highest complete one is
the table. A change writes the buckets it touches as a new version and then one small
manifest, whose single file is moved into place when it is whole: before that the old
version is read, after that the new one, and nothing in between.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table.
BUCKETS = 64
MANIFEST = "number long, bucket int, version string, buckets int, change string, schema string"


class BucketTable:
    """The table at ``path`` by ``keys``; the first ``replace`` makes it."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    # The manifest of a table has a row per bucket, so it is small by construction.
    def manifest(self) -> list:
        """Rows of the highest complete manifest; none where there is no table yet."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/*")
            return rows.join(rows.agg(F.max("number").alias("number")), "number").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows of the table, or of some buckets."""
        found = self.manifest()
        if not found:
            raise FileNotFoundError(self.path)
        schema = T.StructType.fromJson(json.loads(found[0]["schema"]))
        folders = [f"{self.path}/data/{r['version']}/bucket={r['bucket']}" for r in found if r["version"] and (only is None or r["bucket"] in only)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame, change: str = "") -> None:
        """All rows anew."""
        found = self.manifest()
        self._commit(rows, found, found[0]["buckets"] if found else self.buckets, None, change)

    def merge(self, seen: DataFrame, change: str, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Rows of touched buckets become ``combine(old rows, seen)``; a change of the name of the last one is not made again.

        ``combine`` must keep a row's key, so that it stays in its bucket; ``seen`` is read more than once.
        """
        found = self.manifest()
        if change and found[0]["change"] == change:
            return
        n = found[0]["buckets"]
        touched = {r[0] for r in seen.select(self.bucket(n)).distinct().collect()}
        if touched:
            self._commit(combine(self.read(touched), seen), found, n, touched, change)

    def _commit(self, rows: DataFrame, found: list, n: int, touched: set[int] | None, change: str) -> None:
        version = uuid.uuid4().hex
        folder = f"{self.path}/data/{version}"
        rows.withColumn("bucket", self.bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        # Rows may only be computed once, so what was written is asked.
        there = {r[0] for r in self.spark.read.schema(T.StructType([*rows.schema, T.StructField("bucket", T.IntegerType())])).parquet(folder).select("bucket").distinct().collect()}
        self._publish(version, rows.schema, there, found, n, touched, change)

    def _publish(self, version: str, schema: T.StructType, there: set[int], found: list, n: int, touched: set[int] | None, change: str) -> None:
        """One file, moved into place when it is whole, makes a version the table."""
        old = {r["bucket"]: r["version"] for r in found}
        number = found[0]["number"] + 1 if found else 0
        told = schema.json()
        rows = []
        for b in range(n):
            new = (version if b in there else None) if touched is None or b in touched else old.get(b)
            rows.append((number, b, new, n, change, told))
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{number}-{version}")
