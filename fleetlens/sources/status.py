"""Engine status text as metrics: prefix match per line, token by position."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import numbers

# --- Fixed values: where each metric stands. (how the line is found, text, metrics); ----
# --- a metric is (name, token) or (name, high token, low token) for wide counters. -------
# --- ``START`` lines begin with the text, ``HOLD`` lines contain it after their start. ----
START, HOLD = "start", "hold"
PATTERNS = (
    (START, "Mutex spin waits", (("spin_waits", 3), ("spin_rounds", 5), ("os_waits", 8))),
    (START, "RW-shared spins", (("spin_waits", 2), ("spin_waits", 8), ("os_waits", 5), ("os_waits", 11))),
    (START, "Trx id counter", (("innodb_transactions", 3, 4),)),
    (START, "Purge done for trx", (("purged_to", 6, 7),)),
    (START, "History list length", (("history_list", 3),)),
    (HOLD, "read views open inside InnoDB", (("read_views", 0),)),
    (START, "mysql tables in use", (("innodb_tables_in_use", 4), ("innodb_locked_tables", 6))),
    (START, "------- TRX HAS BEEN", (("innodb_lock_wait_secs", 5),)),
    (HOLD, "lock struct(s)", (("innodb_lock_structs", 0),)),
    (HOLD, " OS file reads, ", (("file_reads", 0), ("file_writes", 4), ("file_fsyncs", 8))),
    (START, "Pending normal aio reads:", (("pending_normal_aio_reads", 4), ("pending_normal_aio_writes", 7))),
    (START, "ibuf aio reads", (("pending_ibuf_aio_reads", 3), ("pending_aio_log_ios", 6), ("pending_aio_sync_ios", 9))),
    (START, "Pending flushes (fsync)", (("pending_log_flushes", 4), ("pending_buf_pool_flushes", 7))),
    (START, "Ibuf for space 0: size ", (("ibuf_used_cells", 5), ("ibuf_free_cells", 9), ("ibuf_cell_count", 12))),
    (START, "Ibuf: size ", (("ibuf_used_cells", 2), ("ibuf_free_cells", 6), ("ibuf_cell_count", 9))),
    (HOLD, " merged recs, ", (("ibuf_inserts", 0), ("ibuf_merged", 2), ("ibuf_merges", 5))),
    (START, "Hash table size ", (("hash_index_cells_total", 3), ("hash_index_cells_used", 6))),
    (HOLD, " log i/o's done, ", (("log_writes", 0),)),
    (HOLD, " pending log writes, ", (("pending_log_writes", 0), ("pending_chkp_writes", 4))),
    (START, "Log sequence number", (("innodb_lsn", 3, 4),)),
    (START, "Log flushed up to", (("flushed_to", 4, 5),)),
    (START, "Last checkpoint at", (("last_checkpoint", 3, 4),)),
    (START, "Total memory allocated", (("total_mem_alloc", 3), ("additional_pool_alloc", 8))),
    (START, "Adaptive hash index ", (("adaptive_hash_memory", 3),)),
    (START, "Page hash           ", (("page_hash_memory", 2),)),
    (START, "Dictionary cache    ", (("dictionary_cache_memory", 2),)),
    (START, "File system         ", (("file_system_memory", 2),)),
    (START, "Lock system         ", (("lock_system_memory", 2),)),
    (START, "Recovery system     ", (("recovery_system_memory", 2),)),
    (START, "Threads             ", (("thread_hash_memory", 1),)),
    (START, "innodb_io_pattern   ", (("innodb_io_pattern_memory", 1),)),
    (START, "Buffer pool size ", (("pool_size", 3),)),
    (START, "Free buffers", (("free_pages", 2),)),
    (START, "Database pages", (("database_pages", 2),)),
    (START, "Modified db pages", (("modified_pages", 3),)),
    (START, "Pages read", (("pages_read", 2), ("pages_created", 4), ("pages_written", 6))),
    (START, "Number of rows inserted", (("rows_inserted", 4), ("rows_updated", 6), ("rows_deleted", 8), ("rows_read", 10))),
    (HOLD, " queries inside InnoDB, ", (("queries_inside", 0), ("queries_queued", 4))),
)
SUMMED = (
    "spin_waits", "spin_rounds", "os_waits", "innodb_tables_in_use", "innodb_locked_tables",
    "innodb_lock_wait_secs", "innodb_lock_structs", "current_transactions", "active_transactions", "locked_transactions",
)
HEX_COUNTERS = ("innodb_transactions", "purged_to")
DERIVED = (
    ("unflushed_log", "innodb_lsn", "flushed_to"), ("uncheckpointed_bytes", "innodb_lsn", "last_checkpoint"),
    ("unpurged_txns", "innodb_transactions", "purged_to"),
)
# -------------------------------------------------------------------------------------------


METRIC = "struct<metric:string,hi:int,lo:int,hex:boolean>"
#: What lines of any beginning may contain; those that begin otherwise than any pattern are looked at only if they do.
HELD = "|".join(re.escape(text) for how, text, _ in PATTERNS if how == HOLD)


def _by_word(spark: SparkSession) -> DataFrame:
    """For each word a line may begin with the patterns to try, in order; the empty word stands for all others."""
    def row(i: int):
        how, text, metrics = PATTERNS[i]
        return how, text, [(name, hi, lo[0] if lo else None, name in HEX_COUNTERS) for name, hi, *lo in metrics]

    words = {text.split(" ")[0] for how, text, _ in PATTERNS if how == START}
    rows = []
    for word in ("", *sorted(words)):
        wanted = [i for i, (how, text, _) in enumerate(PATTERNS) if how == HOLD or text.split(" ")[0] == word]
        rows.append((word, [row(i) for i in wanted]))
    return spark.createDataFrame(rows, f"_word string, _try array<struct<how:string,text:string,metrics:array<{METRIC}>>>")


def status_metrics(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, metric, value) of engine status texts; counters are DECIMAL(38,0).

    A line meets the patterns of the word it begins with in a join, so it is tried
    against a few of them only. Metrics that repeat are added up, others take their
    last line. Differences of counters are added as metrics of their own.
    """
    patterns = _by_word(texts.sparkSession)
    lines = texts.select(*keys, F.posexplode(F.split(text, "\n")).alias("_n", "_l")).withColumn("_l", F.trim("_l"))
    line, word = F.col("_l"), F.substring_index("_l", " ", 1)
    known = word.isin(*sorted({t.split(" ")[0] for how, t, _ in PATTERNS if how == START}))
    counted = F.when(line.startswith("---TRANSACTION"), F.when(line.contains("ACTIVE"), F.array(F.lit("current_transactions"), F.lit("active_transactions"))).otherwise(F.array(F.lit("current_transactions"))))
    counted = counted.when(line.startswith("LOCK WAIT"), F.array(F.lit("locked_transactions")))
    lines = lines.withColumns({"_counted": counted, "_word": F.when(known, word).otherwise("")})
    one = F.lit(1).cast("decimal(38,0)")
    first = lines.filter("_counted is not null").select(*keys, "_n", F.explode("_counted").alias("metric"), one.alias("value"))

    held = lines.filter(F.col("_counted").isNull() & ((F.col("_word") != "") | line.rlike(HELD)))
    met = F.filter("_try", lambda p: F.when(p["how"] == START, F.startswith(line, p["text"])).otherwise(F.position(p["text"], line) > 1))
    found = held.join(patterns, "_word").select(*keys, "_n", F.split("_l", " +").alias("_w"), F.explode(F.get(met, F.lit(0))["metrics"]).alias("_m"))
    hi, lo = F.get("_w", F.col("_m.hi")), F.get("_w", F.col("_m.lo"))
    digits = F.regexp_extract(hi, r"(\d+)", 1).try_cast("decimal(38,0)")
    low = F.when(lo.rlike(r"\A\d+\z"), lo)
    single = F.when(F.col("_m.hex"), numbers.hi_lo(hi)).otherwise(digits)
    value = F.when(F.col("_m.lo").isNull(), digits).when(low.isNull(), single).otherwise(numbers.hi_lo(digits, low))
    second = found.select(*keys, "_n", F.col("_m.metric").alias("metric"), value.cast("decimal(38,0)").alias("value"))
    rows = first.unionByName(second).filter("value is not null")
    agg = rows.groupBy(*keys, "metric").agg(F.sum("value").alias("_sum"), F.max_by("value", "_n").alias("_last"))
    value = F.when(F.col("metric").isin(*SUMMED), F.col("_sum")).otherwise(F.col("_last")).cast("decimal(38,0)")
    pick = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    extra = [F.struct(F.lit(n).alias("metric"), (pick(a) - pick(b)).cast("decimal(38,0)").alias("value")) for n, a, b in DERIVED]
    # A status text has at most one row per known metric, so its list is short.
    both = agg.select(*keys, "metric", value.alias("value")).groupBy(*keys).agg(
        F.concat(F.collect_list(F.struct("metric", "value")), F.array(*extra)).alias("_all")
    )
    return both.select(*keys, F.inline("_all")).filter("value is not null and metric <> 'purged_to'")
