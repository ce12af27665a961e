"""Packing documents into sequences of a fixed length.

Each document's ids are cut into full sequences and a rest. Rests are packed
first-fit decreasing in randomised groups of documents: a tournament tree over the
bins' free room finds the first bin that fits. Only lengths and checksums are
shuffled, never ids.

Defined results: a null text counts as empty and holds the end id alone; equal rows
are packed row by row, each into places of its own, and may carry equal or null keys;
columns besides the key and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.llm.bytepairs import encoder
from fleetlens.operators.lineage import written

LENGTH = 1024
END_ID = 0
#: Documents of a group on average; a group is packed in one task, whatever the corpus holds.
GROUP = 8192


class FirstFit:
    """Bins of one capacity in a tournament tree: each node holds the most room below it."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, had


def tokenized(documents: DataFrame, tokenizer: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``doc_tokens`` and the checksums of the pieces of every row: all of ``length`` but the last."""

    def run(batches):
        own = encoder(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            counts, crcs = [], []
            for value in batch.column(1).to_pylist():
                ids = own.encode_marked(value or "") + end
                counts.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * length]) for i in range(0, len(ids), 4 * length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["key", "doc_tokens", "crcs"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, doc_tokens long, crcs array<long>")


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence and offset in it."""
    # Rows are numbered as they are stored, once, so that repeated ones go to different groups.
    rows = written(tokenized(documents, tokenizer, length, key, text).withColumn("row", F.monotonically_increasing_id()), "tokenized")
    n_groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n_groups)))
    kind = rows.schema["key"].dataType.simpleString()

    def run(ident: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[c[0] for c in rows["crcs"]]).sort_values(["key", "doc_tokens", "first"], kind="stable")
        keys, sizes, crcs = rows["key"].array, rows["doc_tokens"].to_numpy(), rows["crcs"].tolist()
        full, rest = sizes // length, sizes % length
        starts = np.concatenate([[0], np.cumsum(full)])
        sequence, offset = np.full(len(rows), -1), np.zeros(len(rows), dtype=np.int64)
        bins = FirstFit(length, len(rows))
        for i in np.argsort(-rest, kind="stable"):
            if rest[i]:
                at, had = bins.place(int(rest[i]))
                sequence[i], offset[i] = starts[-1] + at, length - had
        # Pieces of full length first, then the rests.
        doc = np.repeat(np.arange(len(rows)), full)
        nth = np.arange(starts[-1]) - starts[doc]
        with_rest = np.flatnonzero(rest)
        doc_of, place = np.concatenate([doc, with_rest]), np.concatenate([nth, full[with_rest]])
        return pd.DataFrame({
            "key": keys.take(doc_of), "start": place * length, "length": np.concatenate([np.full(len(doc), length), rest[with_rest]]),
            "ids_crc32": [crcs[d][p] for d, p in zip(doc_of, place)], "doc_tokens": sizes[doc_of],
            "sequence_id": (int(ident[0]) << 32) + np.concatenate([np.arange(len(doc)), sequence[with_rest]]),
            "offset": np.concatenate([np.zeros(len(doc), dtype=np.int64), offset[with_rest]]),
        })

    packed = rows.drop("row").groupBy("group").applyInPandas(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("key", key)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
