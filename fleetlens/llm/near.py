"""Near duplicates: an LSH forest over MinHash signatures, then exact Jaccard similarity of word shingles.

Each tree of the forest is a trie of signature prefixes, as sorted keys. Matching begins
with the longest prefix and is shortened until the chance that a pair at the threshold
meets in some tree reaches the target recall. Texts that meet are compared by their
whole signatures; those that may be similar form candidate groups. Within a group every
pair is decided exactly, block against block, and links are counted where they are
found, so that no list of pairs is ever written.

Texts with the same shingles are one class from the start. Classes joined by links form
a group, named by its smallest key.

Defined results: words are runs without white space; a text of fewer than five words has
one shingle, all its words; a null text or one without words has no shingle, no link and
is a group of its own; rows that repeat a key and text count as copies; a null key is a
group's name only if no row of it has a key; columns besides the key and the text are
ignored by ``classes`` and passed on by ``deduplicate``; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.llm.components import components
from fleetlens.operators.lineage import written

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Trees of the forest and the longest prefix of one.
TREES, DEPTH = 20, 6
#: Share of equal signature values below which a pair is not decided exactly: five standard deviations under the threshold.
SKETCH_SLACK = 5.0
#: Texts of one block where a bucket or a group is split, and shingles multiplied at once.
BLOCK, COLUMNS = 256, 4096

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose hashes a task remembers; bounds memory only.
REMEMBERED = 100_000

_rng = np.random.default_rng(20240607)
MULTIPLIERS = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
POSITIONS = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit names of the distinct word shingles of a whole text."""
    words = WORD.findall(text or "")
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WIDTH + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(WIDTH, len(h))):
        total += _mixed(h[i : i + n]) * POSITIONS[i]
    return np.unique(_mixed(total))


def signature(names: np.ndarray) -> np.ndarray:
    """The least hash of the shingles under each function, 32 bits each."""
    low = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(names), 8192):
        low = np.minimum(low, (names[i : i + 8192, None] * MULTIPLIERS + OFFSETS).min(axis=0))
    return (low >> np.uint64(32)).astype(">u4")


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def signed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text_hash``, ``digest`` of the shingles, their number ``n``, the signature ``sig`` and ``sketch``, a byte of each value; nulls without words."""

    def run(batches):
        for batch in batches:
            digests, counts, sigs, sketches = [], [], [], []
            for value in batch.column(2).to_pylist():
                names = shingles(value)
                counts.append(len(names))
                digests.append(hashlib.blake2b(names.tobytes(), digest_size=16).digest() if len(names) else None)
                sig = signature(names).tobytes() if len(names) else None
                sigs.append(sig)
                sketches.append(sig and sig[3::4])
            made = (pa.array(digests, pa.binary()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["key", "text_hash", "digest", "n", "sig", "sketch"])

    rows = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text_hash long, digest binary, n int, sig binary, sketch binary")


def _by_group(batches):
    """Tables of whole groups from batches that are sorted by ``group``."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        group = table.column("group").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(group[1:] != group[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield table.slice(0, cut), np.concatenate([[0], ends[:-1] + 1, [cut]])
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.array([0, table.num_rows])


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row it is connected to."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocked(rows: DataFrame, count: str, ident: str) -> DataFrame:
    """Each row once for every block its block is held against; ``group`` names the two blocks."""
    blocks = F.ceil(F.col(count) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("group", F.concat_ws(":", F.hex(ident), F.least("block", "other"), F.greatest("block", "other"))).drop("blocks", "other")


def candidates(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges ``a``, ``b`` that connect all classes that may be similar; few of each bucket's pairs are written."""
    length = prefix_length(threshold, recall)
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.col("sig").substr(t * (4 * DEPTH) + 1, F.lit(4 * length))))
    keyed = classes.select("digest", F.explode(keys).alias("bucket"))
    full = keyed.groupBy("bucket").count().filter("count > 1")
    met = written(keyed.join(full, "bucket"), "met")
    sketches = classes.select("digest", "n", "sketch")
    placed = _blocked(met.join(sketches, "digest"), "count", "bucket").select("group", "digest", "n", "sketch")
    values = TREES * DEPTH
    least = int(values * threshold - SKETCH_SLACK * (values * threshold * (1 - threshold)) ** 0.5)

    def run(batches):
        for table, bounds in _by_group(batches):
            digests = table.column("digest").to_pylist()
            sigs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(digests), -1)
            sizes = table.column("n").to_numpy()
            left, right = [], []
            counts = np.diff(bounds)
            first = bounds[:-1][counts == 2]
            same = (sigs[first] == sigs[first + 1]).sum(axis=1) >= least
            fits = np.minimum(sizes[first], sizes[first + 1]) >= threshold * np.maximum(sizes[first], sizes[first + 1])
            for i in first[same & fits]:
                left.append(digests[i]), right.append(digests[i + 1])
            for a, b in zip(bounds[:-1][counts > 2], bounds[1:][counts > 2]):
                own, size = sigs[a:b], sizes[a:b]
                linked = np.array([(own == s).sum(axis=1) for s in own]) >= least
                linked &= np.minimum(size[:, None], size) >= threshold * np.maximum(size[:, None], size)
                for i, root in enumerate(_forest(linked)):
                    if i != root:
                        left.append(digests[a + i]), right.append(digests[a + root])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return placed.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a binary, b binary")


def _overlaps(names: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares."""
    flat = np.concatenate(names)
    owner = np.repeat(np.arange(len(names)), [len(x) for x in names])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # what one set holds alone is in no overlap
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    out = np.zeros((len(names), len(names)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(names), COLUMNS), dtype=np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        out += held @ held.T
    return out


def links(documents: DataFrame, members: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact links within candidate groups: ``a``, the texts and documents it is linked to, and an edge ``b`` or null.

    ``members`` has ``digest``, ``key``, ``text_hash`` and ``copies`` of each class and its ``component``.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("count"))
    wanted = members.join(sizes, "component").withColumnRenamed("key", "_key")
    texts = documents.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    found = texts.join(wanted, (F.col("hash") == F.col("text_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    found = found.select("text", "digest", "component", "copies", "count")

    def cut(batches):
        for batch in batches:
            names = [shingles(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *batch.columns[1:]], ["names", "digest", "component", "copies", "count"])

    placed = _blocked(found.mapInArrow(cut, "names binary, digest binary, component binary, copies long, count long"), "count", "component")

    def run(batches):
        for table, bounds in _by_group(batches):
            groups, all_blocks = table.column("group").to_pylist(), table.column("block").to_numpy()
            digests, copies = table.column("digest").to_pylist(), table.column("copies").to_numpy()
            data = table.column("names").to_pylist()
            out: list[tuple] = []
            for a, b in zip(bounds, bounds[1:]):
                rows = list({digests[i]: i for i in range(a, b)}.values())  # a repeated row counts once
                names = [np.frombuffer(data[i], dtype=np.uint64) for i in rows]
                size = np.array([len(x) for x in names], dtype=np.float64)
                common = _overlaps(names)
                linked = common * (1 + threshold) >= threshold * (size[:, None] + size) - 1e-6
                np.fill_diagonal(linked, False)
                _, i, j = groups[a].rsplit(":", 2)
                block = all_blocks[rows]
                if i != j:
                    linked &= block[:, None] != block
                roots, weight = _forest(linked), copies[rows]
                for k, row in enumerate(rows):
                    if linked[k].any():
                        out.append((digests[row], int(linked[k].sum()), int(weight[linked[k]].sum()), digests[rows[roots[k]]] if roots[k] != k else None))
            if out:
                a, n, m, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(b, pa.binary())], ["a", "texts", "documents", "b"])

    return placed.select("group", "block", "digest", "copies", "names").repartition("group").sortWithinPartitions("group").mapInArrow(run, "a binary, texts long, documents long, b binary")


def classes(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, ``text_hash``, ``class_id`` and ``class_hash``, the key and hash of the row that names its class, ``n_links`` to other documents and ``n_linked_texts`` to other shingle sets."""
    signs = written(signed(documents, key, text), "signed")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash"))
    reps = signs.filter(F.col("digest").isNotNull()).groupBy("digest").agg(first.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    reps = written(reps.select("digest", "first.key", "first.text_hash", "copies", "n", "sig", "sketch"), "classes")
    near = components(candidates(reps, threshold, recall), "candidates")
    members = reps.select("digest", "key", "text_hash", "copies").join(near.withColumnRenamed("node", "digest"), "digest")
    linked = written(links(documents, members, threshold, key, text), "links")
    counts = linked.groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    groups = components(linked.filter("b is not null").select("a", "b"), "groups")
    named = reps.select("digest", "key", "text_hash", "copies").join(groups.withColumnRenamed("node", "digest"), "digest", "left").join(counts.withColumnRenamed("a", "digest"), "digest", "left")
    named = named.withColumn("component", F.coalesce("component", "digest"))
    # The row that names a group: ids may be shared or missing, so its text tells it as well.
    names = named.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("first"))
    told = named.join(names, "component").select("digest", F.col("first.key").alias("class_id"), F.col("first.text_hash").alias("class_hash"), "copies", "texts", "documents")
    rows = signs.select("key", "text_hash", "digest").join(told, "digest", "left")
    lone = F.col("digest").isNull()
    return rows.select(
        F.col("key").alias(key), "text_hash", F.when(lone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("text_hash")).otherwise(F.col("class_hash")).alias("class_hash"),
        F.when(lone, 0).otherwise(F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
    )


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns; of a repeated row all stay."""
    found = classes(documents, threshold, recall, key, text)
    stays = found.filter(F.col(key).eqNullSafe(F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("class_hash")))
    stays = stays.select(F.col(key).alias("stays"), F.col("text_hash").alias("as"))
    rows = documents.select(F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("whole"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    return rows.join(stays, F.col("key").eqNullSafe(F.col("stays")) & (F.col("hash") == F.col("as")), "left_semi").select("whole.*")


@query("op4_near_duplicates")
def op4_near_duplicates(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "class_hash")
