"""Cross-entropy difference: how much better a target model predicts a text than a background model.

Both are bigram models with the same smoothing over one vocabulary, every word of the
corpus. The background is all documents, the target those marked as such. A document's
score is its mean loss per token under the target model less that under the background
model: low scores are like the target. Counts are taken over whole texts of all documents
and are exact.

Texts are cut into chunks of rows, whose tokens are stored once. A chunk sends each of its
words once to the word's bucket and gets the word's number; with the numbers it sends each
of its bigrams once to the bigram's bucket and gets its counts in the corpus. So no row is
per token, frequent words and bigrams are one entry per chunk, and only two sums pass through
the driver, with the vocabulary if the caller bounds it. A bigram's bucket follows from its
first word; words that occur often are dealt over several buckets, by the second word.

Defined results: a null text counts as empty; a text without words has no tokens and
score 0; a document is in the target if any row with its id is marked; without target
every word is scored against the unigram start; rows are scored one by one, so repeated
rows give repeated results; columns besides the key and the text are ignored; an empty
table gives an empty result; a word that the corpus does not hold counts as unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.operators.lineage import written

#: What stands for words outside a vocabulary that the caller bounds; no word is empty.
UNKNOWN = ""
#: What absolute discounting takes from each count of a bigram.
DISCOUNT = 0.75
#: Tokens and rows after which a chunk ends; they bound memory only.
TOKENS = 2_000_000
ROWS = 50_000
#: Tokens of the corpus for each bucket, and how many buckets there are at least.
BUCKET = 2_000_000
BUCKETS = 32
#: A word is dealt over one more bucket for each so many occurrences, or for each so large a part of all tokens if that is more.
OFTEN = 100_000
PARTS = 20_000
#: Words a task holds before it hands its counts on; bounds memory only.
COUNTED = 400_000

MESSAGE = "chunk long, bucket int, data binary"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def vocabulary(documents: DataFrame, size: int, text: str = "text") -> list[str]:
    """The most frequent words of all texts, ties by the word itself; ``size - 2`` at most."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(words_of(value))
                if len(counts) > COUNTED:
                    yield flush()
        if counts:
            yield flush()

    counted = documents.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(size - 2).collect()]


def pack(*parts: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, in as few bytes as their largest needs, like bytes together."""
    widths = [(int(p.max()).bit_length() + 7) // 8 if len(p) else 0 for p in parts]
    body = b"".join(np.ascontiguousarray(p, "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for p, w in zip(parts, widths))
    head = np.array([len(parts), *(len(p) for p in parts)], "<u4").tobytes() + bytes(widths)
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    lengths, widths = np.frombuffer(data, "<u4", count, 4).tolist(), list(data[4 + 4 * count : 4 + 5 * count])
    size = sum(n * w for n, w in zip(lengths, widths))
    body = np.frombuffer(pa.decompress(data[4 + 5 * count :], size, codec="zstd", asbytes=True), np.uint8) if size else np.empty(0, np.uint8)
    out, at = [], 0
    for n, w in zip(lengths, widths):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = body[at : at + n * w].reshape(w, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += n * w
    return out


def pack_words(words: list[str]) -> bytes:
    text = " ".join(words).encode()
    return np.array([len(text)], "<u8").tobytes() + pa.compress(text, codec="zstd", asbytes=True)


def unpack_words(data: bytes) -> list[str]:
    size = int(np.frombuffer(data, "<u8", 1)[0])
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).decode().split(" ") if size else [UNKNOWN]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers of whole numbers."""
    x = values.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def hashed(words: list[str]) -> np.ndarray:
    """Hashes of words, which tell their buckets only; three bytes are enough for that."""
    return np.fromiter((zlib.crc32(w.encode()) >> 8 for w in words), np.int64, len(words))


class Numbers(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def cut(documents: DataFrame, key: str = "doc_id", text: str = "text", words: list[str] | None = None) -> DataFrame:
    """One stored row per chunk: its documents' keys, and their words as numbers of the chunk's own list; words not in ``words`` are unknown."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        known = None if words is None else frozenset(words)
        at = TaskContext.get().partitionId() << 32
        numbers, keys, ids, n = Numbers(), [], [], 0

        def flush():
            tokens = np.concatenate(ids)
            uses = np.bincount(tokens, minlength=len(numbers))
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = list(numbers)
            column = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.array([len(tokens)], pa.int64()), pa.array([len(column)], pa.int64()),
                 pa.array([pack(np.array([len(x) for x in ids]), rank[tokens])], pa.binary()), pa.array([pack(uses[order])], pa.binary()),
                 pa.array([pack_words([own[i] for i in order])], pa.binary()), pa.array([pack(hashed([own[i] for i in order]))], pa.binary())],
                ["chunk", "keys", "n", "rows", "tokens", "uses", "words", "hashes"])

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1).to_pylist()):
                found = words_of(value)
                if known is not None:
                    found = [w if w in known else UNKNOWN for w in found]
                ids.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                n += len(found)
                if n >= TOKENS or len(ids) >= ROWS:
                    keys.append(batch.column(0).slice(start, i + 1 - start))
                    yield flush()
                    numbers, keys, ids, n, start, at = Numbers(), [], [], 0, i + 1, at + 1
            if start < batch.num_rows:
                keys.append(batch.column(0).slice(start))
        if ids:
            yield flush()

    return written(rows.mapInArrow(run, f"chunk long, keys array<{kind}>, n long, rows long, tokens binary, uses binary, words binary, hashes binary"), "chunks")


@dataclass(frozen=True)
class Model:
    """Both models, as the chunks of the corpus and the places of the target's documents in them; ``size`` as the caller bounds it."""

    chunks: DataFrame
    target: DataFrame
    words: list[str] | None
    size: int | None
    key: str


def train(documents: DataFrame, target_ids: DataFrame, size: int | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """Both models from all documents; ``target_ids`` has the ids of the target in ``key``. ``size`` bounds the vocabulary for callers that want it."""
    words = None if size is None else vocabulary(documents, size, text)
    chunks = cut(documents, key, text, words)
    target = target_ids.select(F.col(key).alias("_id")).distinct()
    # Ids alone go through the join, and the target's are never broadcast.
    places = chunks.select("chunk", F.posexplode("keys").alias("place", "_key")).join(target.hint("merge"), F.col("_key") == F.col("_id"), "left_semi")
    return Model(chunks, places.groupBy("chunk").agg(F.collect_list("place").alias("places")), words, size, key)


def cuts(buckets: np.ndarray, count: int) -> list[np.ndarray]:
    """Ascending places by bucket."""
    order = np.argsort(buckets, kind="stable")
    return np.split(order, np.searchsorted(buckets[order], np.arange(1, count)))


@dataclass(frozen=True)
class Deal:
    """How words and bigrams are dealt over buckets; what a chunk sends and what it gets back have the same order."""

    buckets: int
    often: int
    starts: int

    def words(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Places of words by bucket."""
        return cuts(hashes % self.buckets, self.buckets)

    def parts(self, uses: np.ndarray) -> np.ndarray:
        """Over how many parts the bigrams of a first word are dealt, from its uses in the corpus."""
        return 1 + uses // self.often

    def bigrams(self, hashes: np.ndarray, uses: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By bucket: places of bigrams, where among these a first word begins, and more first words of which the bucket has a part.

        ``hashes`` and ``uses`` are of the start of a text and of the chunk's words.
        """

        def at(word, part):
            return (mixed(hashes[word].astype(np.uint64) ^ mixed(part + 1)) % np.uint64(self.buckets)).astype(np.int64)

        parts = self.parts(uses)
        own = cuts(at(first, (mixed(hashes[second]) % parts[first].astype(np.uint64)).astype(np.int64)), self.buckets)
        often = np.unique(first)
        often = often[parts[often] > 1]
        asked = np.repeat(often, parts[often])
        part = np.arange(len(asked)) - np.repeat(np.cumsum(parts[often]) - parts[often], parts[often])
        more = cuts(at(asked, part), self.buckets)
        return [(o, np.flatnonzero(np.diff(first[o], prepend=-1)), np.setdiff1d(asked[m], first[o])) for o, m in zip(own, more)]


def words_sent(chunks: DataFrame, deal: Deal) -> DataFrame:
    """Each chunk's words by bucket, with their uses in the corpus."""

    def run(batches):
        for batch in batches:
            for chunk, counted, uses, words, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                n = unpack(uses)[0] * counted
                own = unpack_words(words) if len(n) else []
                sent = [(b, pack(n[p]), pack_words([own[i] for i in p])) for b, p in enumerate(deal.words(unpack(hashes)[0])) if len(p)]
                buckets, data, texts = zip(*sent) if sent else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(sent), pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary()), pa.array(texts, pa.binary())],
                    ["chunk", "bucket", "data", "words"])

    return chunks.select("chunk", F.col("counted").cast("long"), "uses", "words", "hashes").mapInArrow(run, MESSAGE + ", words binary")


def words_named(sent: DataFrame, deal: Deal) -> DataFrame:
    """For each message the words' numbers in the corpus and over how many parts each is dealt."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        numbers = Numbers()
        read = []
        for data, words in zip(table.column("data").to_pylist(), table.column("words").to_pylist()):
            (n,) = unpack(data)
            read.append((np.fromiter(map(numbers.__getitem__, unpack_words(words)), np.int64, len(n)), n))
        total = np.bincount(np.concatenate([w for w, _ in read]), weights=np.concatenate([n for _, n in read])).astype(np.int64)
        own = list(numbers)
        rank = np.empty(len(own), np.int64)
        rank[sorted(range(len(own)), key=lambda i: (-total[i], own[i]))] = np.arange(len(own))
        # 0 is the start of a text.
        number = 1 + bucket + rank * deal.buckets
        if number.max() >> 31:
            raise ValueError("numbers of words have 31 bits, so that a bigram is one number")
        out = [pack(number[w], deal.parts(total)[w]) for w, _ in read]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def tokens_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: tokens per document, the tokens, its different bigrams as two columns (0 is the start, words from 1 on), and the bigram of each token."""
    lengths, tokens = unpack(data)
    tokens = tokens + 1
    before = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
    begins = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[begins] = 0
    codes, at = np.unique(before << 32 | tokens, return_inverse=True)
    return lengths, tokens, codes >> 32, codes & 0xFFFFFFFF, at


def bigrams_sent(chunks: DataFrame, named: DataFrame, deal: Deal) -> DataFrame:
    """Each chunk's words and bigrams by bucket, with their counts in the target and in all; ``named`` also has the target's places."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        counted = int(left.column("counted")[0].as_py())
        lengths, tokens, first, second, at = tokens_of(left.column("tokens")[0].as_py())
        size = int(tokens.max()) + 1 if len(tokens) else 1
        hashes = np.append(0, unpack(left.column("hashes")[0].as_py())[0])
        words = [w + 1 for w in deal.words(hashes[1:])]
        number, uses = np.zeros(size, np.int64), np.zeros(size, np.int64)
        uses[0] = deal.starts
        marked = np.zeros(len(lengths), np.int64)
        for bucket, data, places in zip(*(right.column(c).to_pylist() for c in ("bucket", "data", "places"))):
            if data is None:
                marked[places] = 1
            else:
                number[words[bucket]], parts = unpack(data)
                uses[words[bucket]] = (parts - 1) * deal.often
        marked = np.repeat(marked, lengths) * counted
        both = [np.bincount(at, minlength=len(first)) * counted, np.bincount(at, weights=marked, minlength=len(first)).astype(np.int64)]
        alone = [np.bincount(tokens, minlength=size) * counted, np.bincount(tokens, weights=marked, minlength=size).astype(np.int64)]
        out = []
        for (own, begins, more), w in zip(deal.bigrams(hashes, uses, first, second), words):
            out.append(pack(
                number[first[own[begins]]], np.diff(begins, append=len(own)), number[second[own]], both[0][own], both[1][own],
                number[more], number[w], alone[0][w], alone[1][w]))
        return pa.table({"chunk": pa.array([left.column("chunk")[0].as_py()] * len(out), pa.int64()), "bucket": pa.array(range(len(out)), pa.int32()), "data": pa.array(out, pa.binary())})

    return chunks.select("chunk", "counted", "tokens", "hashes").groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(run, MESSAGE)


def summed(keys: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different keys, the place of each key among them, and sums of the counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, at, [np.bincount(at, weights=np.concatenate(c), minlength=len(found)).astype(np.int64) for c in counts]


def bigrams_counted(sent: DataFrame) -> DataFrame:
    """For each message counts in all and in the target: of bigrams, of what follows their first words, and of words."""

    def run(table: pa.Table) -> pa.Table:
        read = [unpack(d) for d in table.column("data").to_pylist()]
        codes, at, (all_n, target_n) = summed([np.repeat(m[0], m[1]) << 32 | m[2] for m in read], [m[3] for m in read], [m[4] for m in read])
        firsts, begins = np.unique(codes >> 32, return_index=True)
        # Per first word: tokens after it and different words after it, in both models; the last row is for words the bucket has not met.
        follow = np.zeros((4, len(firsts) + 1), np.int64)
        if len(codes):
            follow[:, :-1] = [np.add.reduceat(x, begins) for x in (all_n, target_n, (all_n > 0).astype(np.int64), (target_n > 0).astype(np.int64))]
        _, word_at, (word_all, word_target) = summed([m[6] for m in read], [m[7] for m in read], [m[8] for m in read])
        sums = np.array([np.count_nonzero(word_all), word_all.sum(), word_target.sum()])
        out, a, w = [], 0, 0
        for m in read:
            own, words = at[a : a + len(m[2])], word_at[w : w + len(m[6])]
            a, w = a + len(m[2]), w + len(m[6])
            asked = np.concatenate([m[0], m[5]])
            place = np.searchsorted(firsts, asked)
            place[np.append(firsts, -1)[place] != asked] = len(firsts)
            out.append(pack(all_n[own], target_n[own], *follow[:, place], word_all[words], word_target[words], sums))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def losses(n: np.ndarray, after: np.ndarray, kinds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Loss of bigrams by interpolated absolute discounting; after a word never met, of the unigram share."""
    total = np.maximum(after, 1)
    return -np.log(np.where(after > 0, np.maximum(n - DISCOUNT, 0) / total + DISCOUNT * kinds / total * share, share))


def differences(chunks: DataFrame, counted: DataFrame, deal: Deal, kind: str, size: int | None) -> DataFrame:
    """``key``, ``n_tokens`` and ``total``, the sum of loss differences, of every document of the chunks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], left.schema.field("keys").type.value_type), "n_tokens": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        lengths, tokens, first, second, at = tokens_of(left.column("tokens")[0].as_py())
        words = int(tokens.max()) + 1 if len(tokens) else 1
        both, alone, follow, sums = np.zeros((2, len(first))), np.zeros((2, words)), np.zeros((4, words)), np.zeros(3)
        hashes = np.append(0, unpack(left.column("hashes")[0].as_py())[0])
        answers = dict(zip(right.column("bucket").to_pylist(), map(unpack, right.column("data").to_pylist())))
        for bucket, places in enumerate(deal.words(hashes[1:])):
            *_, word_all, word_target, total = answers[bucket]
            alone[:, places + 1] = word_all, word_target
            sums += total
        uses = alone[0].astype(np.int64)
        uses[0] = deal.starts
        for bucket, (own, begins, more) in enumerate(deal.bigrams(hashes, uses, first, second)):
            all_n, target_n, *after = answers[bucket][:6]
            both[:, own] = all_n, target_n
            follow[:, np.concatenate([first[own[begins]], more])] += after
        vocabulary_size = size or sums[0] + 2
        background, target = (losses(both[i], follow[i][first], follow[2 + i][first], ((alone[i] + 1) / (sums[1 + i] + vocabulary_size))[second]) for i in (0, 1))
        totals = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=(target - background)[at], minlength=len(lengths))
        return pa.table({"key": left.column("keys").combine_chunks().flatten(), "n_tokens": pa.array(lengths, pa.int64()), "total": pa.array(totals, pa.float64())})

    return chunks.select("chunk", "keys", "tokens", "hashes").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(run, f"key {kind}, n_tokens long, total double")


#: What scoring needs of a chunk that is not scored itself.
HELD = ("chunk", "n", "rows", "tokens", "uses", "words", "hashes")


def scored(asked: DataFrame, corpus: DataFrame, model: Model, key: str) -> DataFrame:
    """Scores of the documents of ``asked``; ``corpus`` are all chunks, with ``counted`` for those the models rest on."""
    tokens, rows = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    deal = Deal(max(BUCKETS, tokens // BUCKET), max(OFTEN, tokens // PARTS), rows)
    named = words_named(words_sent(corpus, deal), deal).withColumn("places", F.lit(None).cast("array<int>"))
    named = named.unionByName(model.target.select("chunk", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("data"), "places"))
    counts = bigrams_counted(bigrams_sent(corpus, named, deal))
    found = differences(asked, counts, deal, asked.schema["keys"].dataType.elementType.simpleString(), model.size)
    return found.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).otherwise(0.0)).withColumnRenamed("key", key)


def score_corpus(model: Model) -> DataFrame:
    """As ``score``, of the documents that the model was trained on, which are cut once."""
    return scored(model.chunks, model.chunks.withColumn("counted", F.lit(True)), model, model.key)


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``score`` and ``total``, the sum of loss differences, of every row of any documents."""
    # Chunks of the corpus keep their numbers; these lie below 0.
    asked = cut(documents, key, text, model.words).withColumn("chunk", -1 - F.col("chunk"))
    corpus = model.chunks.select(*HELD, F.lit(True).alias("counted")).unionByName(asked.select(*HELD, F.lit(False).alias("counted")))
    return scored(asked, corpus, model, key)


@query("op5_cross_entropy")
def op5_cross_entropy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_corpus(train(documents, labels.filter("quality = 1")))
