"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed size. Equal blocks get one integer name by
sorting, then adjacent pairs of names are named in turn, until a text has one name at
its level. Names come from comparing contents, so two texts share a name only if they
are equal. A text that holds a block or pair found nowhere else is unique and leaves.

A chunk of rows sends each block it holds once and gets the names back, so a block that
a third of the corpus holds costs one row per chunk, not one per text.

Defined results: a null text counts as empty; equal texts form one group, empty ones
too; the row with the smallest key stays, null keys last, and of repeated rows with one
key the first read; columns besides the key and the text are ignored by ``groups`` and
passed on by ``deduplicate``; an empty table gives an empty result. The input should be a
stored table, so that a task that is run again reads the same rows in the same order.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm import query
from fleetlens.operators.lineage import written

#: Bytes of a block.
BLOCK = 2048
#: Rows and bytes of a chunk at most (one row may be longer).
CHUNK_ROWS, CHUNK_BYTES = 2000, 6_000_000
SPACES = re.compile(r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]")


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with every run of white space as one space."""
    return SPACES.sub(" ", text or "").encode()


def _text_parts(block: int):
    def parts(text):
        data = normalised(text)
        return [data[i : i + block] for i in range(0, len(data), block)] or [b""], hashlib.sha256(data).hexdigest()

    return parts


def _pair_parts(names):
    names = np.asarray(names, dtype="<i8")
    if len(names) % 2:
        names = np.append(names, -1)
    data = names.tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)], None


def _chunks(rows: DataFrame, parts, kind: str) -> DataFrame:
    """Rows by chunk: a ``part`` with its place and count, or a row with the places of its parts.

    ``rows`` has ``row`` (null at first), ``key``, ``sha`` and ``value``.
    """

    def run(batches):
        task = TaskContext.get().partitionId() << 40
        n = 0
        held: dict[bytes, list[int]] = {}
        out: list[tuple] = []
        size = 0

        def flush():
            chunk = task + n
            places = [i for i, _ in held.values()]
            cols = [
                pa.array([chunk] * (len(held) + len(out)), pa.int64()), pa.array([*held, *[None] * len(out)], pa.binary()),
                pa.array([*places, *[None] * len(out)], pa.int32()), pa.array([*(c for _, c in held.values()), *[None] * len(out)], pa.int64()),
                *(pa.array([*[None] * len(held), *(r[i] for r in out)], t) for i, t in enumerate((pa.int64(), key_type, pa.string(), pa.list_(pa.int32())))),
            ]
            return pa.RecordBatch.from_arrays(cols, ["chunk", "part", "place", "n", "row", "key", "sha", "places"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for row, key, sha, value in zip(*(c.to_pylist() for c in batch.columns)):
                found, digest = parts(value)
                places = []
                for p in found:
                    hit = held.setdefault(p, [len(held), 0])
                    hit[1] += 1
                    places.append(hit[0])
                n += 1
                size += sum(map(len, found))
                out.append((task + n if row is None else row, key, sha or digest, places))
                if len(out) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                    yield flush()
                    held, out, size = {}, [], 0
        if out:
            yield flush()

    return rows.select("row", "key", "sha", "value").mapInArrow(
        run, f"chunk long, part binary, place int, n long, row long, key {kind}, sha string, places array<int>"
    )


def _named(rows: DataFrame, parts, kind: str, level: int) -> DataFrame:
    """``row``, ``key``, ``sha``, ``names`` of the parts, and ``single``: whether some part occurs once only."""
    chunks = written(_chunks(rows, parts, kind), f"chunks-{level}")
    sent = chunks.filter(F.col("part").isNotNull()).groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "place")).alias("at"))
    names = sent.sortWithinPartitions("part").select(F.monotonically_increasing_id().alias("name"), (F.col("n") == 1).alias("once"), "at")
    names = names.select("name", "once", F.explode("at").alias("a")).select("name", "once", "a.chunk", "a.place")
    asked = chunks.filter(F.col("part").isNull()).select("chunk", "row", "key", "sha", "places")

    def back(asked: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        name, once = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        name[names["place"]], once[names["place"]] = names["name"], names["once"]
        places = [np.asarray(p, dtype=np.int64) for p in asked["places"]]
        return pd.DataFrame({"row": asked["row"], "key": asked["key"], "sha": asked["sha"], "names": [name[p] for p in places], "single": [bool(once[p].any()) for p in places]})

    told = asked.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInPandas(back, f"row long, key {kind}, sha string, names array<long>, single boolean")
    return written(told, f"names-{level}")


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row."""
    kind = documents.schema[key].dataType.simpleString()
    null = F.lit(None)
    rows = documents.select(null.cast("long").alias("row"), F.col(key).alias("key"), null.cast("string").alias("sha"), F.col(text).alias("value"))
    level, done = 0, []
    named = _named(rows, _text_parts(block), kind, level)
    while True:
        ended = F.col("single") | (F.size("names") == 1)
        done.append(named.filter(ended).select("row", "key", "sha", "single", F.lit(level).alias("level"), F.get("names", F.lit(0)).alias("name")))
        left = named.filter(~ended)
        if left.isEmpty():
            break
        level += 1
        named = _named(left.withColumnRenamed("names", "value"), _pair_parts, kind, level)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionAll(more)
    alone, shared = rows.filter("single"), rows.filter("not single")
    first = shared.groupBy("level", "name").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first"), F.count("*").alias("group_size"))
    # Written first, so that the join's own exchange feeds nothing else and a large group's rows can be split.
    first = written(first, "groups")
    met = shared.join(first, ["level", "name"]).select("key", F.col("first.key").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "sha")
    out = alone.select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha").unionAll(met)
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def deduplicate(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    stays = groups(documents, key, text).filter("kept").select(F.col(key).alias("stays"), F.col("text_sha256").alias("as"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    rows = documents.select(F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("whole"), F.col(key).alias("key"), sha.alias("sha"))
    rows = rows.join(stays, F.col("key").eqNullSafe(F.col("stays")) & (F.col("sha") == F.col("as")), "left_semi")
    # Of repeated rows with one key and text, one stays.
    nth = F.row_number().over(Window.partitionBy("key", "sha").orderBy(F.lit(0)))
    return rows.withColumn("nth", nth).filter("nth = 1").select("whole.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


@query("op6_exact_duplicates", SQL)
def op6_exact_duplicates(spark, sf_dir):
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
