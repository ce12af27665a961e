"""Chunked checksums of tables and their differences between replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 50_000


def chunk_of(key: str, low, size: int = DEFAULT_CHUNK) -> Column:
    """Chunk number ``floor((key - min) / size)``; no driver-side walk over the range."""
    return F.floor((F.col(key) - low) / size).cast("long")


def chunk_checksums(table: DataFrame, key: str, columns: list[str], size: int = DEFAULT_CHUNK,
                    where: str | None = None, low: int | None = None) -> DataFrame:
    """Rows, key bounds and an order-free checksum of each key range.

    The checksum is an XOR of row hashes, so it combines map side: what is
    shuffled is one row per chunk and task. Equal tables need the same ``low``.
    """
    x = table if where is None else table.filter(F.expr(where))
    start = F.lit(low) if low is not None else x.agg(F.min(key)).scalar()
    return x.groupBy(chunk_of(key, start, size).alias("chunk")).agg(
        F.min(key).alias("lower_boundary"), F.max(key).alias("upper_boundary"),
        F.count(F.lit(1)).alias("cnt"), F.bit_xor(F.xxhash64(*columns)).alias("crc"),
    )


def compare_checksums(replica: DataFrame, master: DataFrame, keys=("db", "tbl", "chunk")) -> DataFrame:
    """Checksum rows of a replica beside the master's, as a checksum table stores them."""
    a = replica.select(*keys, F.col("cnt").alias("this_cnt"), F.col("crc").alias("this_crc"))
    b = master.select(*keys, F.col("cnt").alias("master_cnt"), F.col("crc").alias("master_crc"))
    return a.join(b, list(keys), "full_outer")


def checksum_differences(checksums: DataFrame) -> DataFrame:
    """Rows whose count or checksum differs, NULL-aware, with both differences."""
    different = (
        ~F.col("this_cnt").eqNullSafe(F.col("master_cnt")) | ~F.col("this_crc").eqNullSafe(F.col("master_crc"))
    )
    return checksums.filter(different).withColumns({
        "cnt_diff": F.coalesce(F.col("this_cnt") - F.col("master_cnt"), F.lit(0)),
        "crc_diff": F.when(F.col("this_crc").eqNullSafe(F.col("master_crc")), 0).otherwise(1),
    })


def table_checksum(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Row count and order-free checksum of a whole table."""
    return table.agg(F.count(F.lit(1)).alias("cnt"), F.bit_xor(F.xxhash64(*columns)).alias("crc")).select(
        F.lit(name).alias("table_name"), "cnt", "crc"
    )


def compare_table_lists(exported: DataFrame, imported: DataFrame) -> DataFrame:
    """Tables whose checksum differs, or that only one list has."""
    a = exported.select("table_name", F.struct("cnt", "crc").alias("_a"))
    b = imported.select("table_name", F.struct("cnt", "crc").alias("_b"))
    x = a.join(b, "table_name", "full_outer")
    state = (
        F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
        .when(F.col("_a") != F.col("_b"), "different").otherwise("same")
    )
    return x.select(
        "table_name", state.alias("state"), F.col("_a.cnt").alias("exported_cnt"), F.col("_b.cnt").alias("imported_cnt")
    )


def batches(table: DataFrame, key: str, size: int) -> DataFrame:
    """The table with the batch of a key-range walk; every row has exactly one."""
    return table.withColumn("batch", chunk_of(key, table.agg(F.min(key)).scalar(), size))


def walk_order(indexes: DataFrame) -> DataFrame:
    """Usable walk keys of each table in order of preference, best first.

    ``indexes`` has table_name, key_name, key_type and column_type. The number
    of keys of a table is small by nature.
    """
    # The order of preference.
    order = ("primary-int", "primary-timestamp", "unique-int", "unique-timestamp", "key-int", "key-timestamp")
    pair = F.concat_ws("-", "key_type", "column_type")
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), pair)
    w = Window.partitionBy("table_name").orderBy("preference", "key_name")
    return indexes.withColumn("preference", rank).filter("preference > 0").withColumn("position", F.row_number().over(w))
