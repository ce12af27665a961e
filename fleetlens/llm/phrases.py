"""Collocations by dynamic itemset counting.

The corpus is cut into shards that are scanned in a cycle. Single words are counted from
the first scan on; a longer phrase is counted from the scan after the one by which its
first and its last words without one, the two subphrases, have reached the threshold, and
until it has seen every shard once. So lengths are interleaved, and a phrase that is
frequent has been counted over the whole corpus when the cycles end.

A scan knows what to count from one table of a fixed size: for a hash of a phrase the scan
by which it reached the threshold. A slot once set stays, so that a phrase whose subphrases
share slots with others begins early, but still counts for one full cycle: collisions cost
work and change no count. Counts of a scan are combined in its tasks, then by the phrase
itself, and written. A phrase over ``S`` shards reaches ``T`` only if one shard holds
``T / S`` of it, so only such phrases are added up over the scans.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count
as often as they stand there, whatever their keys; phrases do not cross signs that end a
piece, lines or documents; a table without candidates gives an empty result; columns besides
the key, the text and the language are ignored. The input should be a stored table, since it
is scanned several times.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm import query
from fleetlens.operators.lineage import written

# The signs between pieces, and the limits of the report.
ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST, THRESHOLD, BEST = 5, 100, 2000
#: Shards of a cycle.
SHARDS = 2
#: Slots of the table of reached phrases, one byte each: its proven size wherever it is sent.
SLOTS = 1 << 24
#: Bytes joined for one pass and looked at together, bytes held in a task, words remembered and positions gathered before a task hands its counts on; these bound memory only.
BLOB, SEGMENT, HELD, WORDS, POSITIONS = 1 << 20, 1 << 16, 1 << 23, 250_000, 1_500_000
#: Parts into which the rows of one short key are dealt where rows meet.
SALTS = 16

BORDER = b"\xff"  # in no UTF-8 text
LETTERS = bytes(255 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
NEVER = 255


def segments(data: bytes, size: int) -> Iterator[bytes]:
    """A prepared text in parts of about ``size`` bytes, cut where pieces end."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(BORDER, at, at + size)
        if cut <= at:
            cut = data.find(BORDER, at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def placed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a prepared text start and end, the piece each is in, and its hash; no word is taken out of the text."""
    signs = np.frombuffer(data, np.uint8)
    border = signs == 255
    inside = np.concatenate([[False], (signs != 32) & ~border, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    up, down = _powers(len(signs) + 1)
    # The sum of a word's signs by powers of the base, moved back to the first power.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[: len(signs)])])
    h = (total[ends] - total[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return starts, ends, np.cumsum(border)[starts] if len(starts) else starts, h ^ (h >> np.uint64(29))


class Numbers(dict):
    """Numbers of words as they come."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word):
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases that go on by a word."""
    h = (before ^ (before >> np.uint64(31))) * MULTIPLY + word
    return (h ^ (h >> np.uint64(29))) * MIX


def started(lang: str, word: np.ndarray) -> np.ndarray:
    return longer(np.full(len(word), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64), word)


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


def active(pieces: np.ndarray, hashes: np.ndarray, lang: str, reached: np.ndarray, scan: int, shards: int, longest: int) -> dict[int, np.ndarray]:
    """For each length from two on the words at which a phrase starts that this scan counts."""
    at, out = np.arange(len(hashes)), {}
    h = started(lang, hashes)
    since = reached[slots_of(h, len(reached))]
    for length in range(2, longest + 1):
        # Both subphrases: the one that starts here and the one that starts a word later.
        known = since != NEVER
        at, h, since = at[known], h[known], since[known]
        both = np.flatnonzero((at[1:] == at[:-1] + 1) & (pieces[at[:-1]] == pieces[np.minimum(at[:-1] + length - 1, len(pieces) - 1)]))
        latest = np.maximum(since[both], since[both + 1])
        found = at[both]
        out[length] = found[latest.astype(np.int64) >= scan - shards]
        if length < longest:
            h = longer(h[both], hashes[found + length - 1])
            # A phrase is never taken for reached before its parts are, even if others share its slot.
            at, since = found, np.maximum(reached[slots_of(h, len(reached))], latest)
    return out


def counted(places: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Different phrases, as rows of word numbers, and how often each occurs."""
    rows = np.concatenate(places)
    code, levels = rows[:, 0], []
    for j in range(1, length):
        # A pair of what is so far, numbered anew from the third word on, and the next word.
        if j > 1:
            different, code = np.unique(code, return_inverse=True)
            levels.append(different)
        code = code << 32 | rows[:, j]
    found, n = np.unique(code, return_counts=True)
    out = []
    for level in [*levels[::-1], None]:
        out.append(found & 0xFFFFFFFF)
        found = found >> 32 if level is None else level[found >> 32]
    return np.stack([found, *out[::-1]], 1), n


def scanned(documents: DataFrame, table, scan: int, shards: int = SHARDS, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``phrase`` and ``n`` for what this scan counts; the empty phrase stands for all words, in the first cycle.

    ``table`` is the broadcast table of reached phrases, packed: few of its slots are set.
    """

    def run(batches):
        since = np.frombuffer(zlib.decompress(table.value), np.uint8)
        numbers = Numbers()
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        places: dict[tuple[str, int], list[np.ndarray]] = {}
        words: dict[str, np.ndarray] = {}
        totals: dict[str, int] = {}
        n_places = 0

        def take(lang):
            nonlocal n_places
            del sizes[lang]
            counted_ids = []
            for data in segments(BORDER.join(held.pop(lang)).translate(LETTERS), SEGMENT):
                starts, ends, pieces, hashes = placed_words(data)
                if not len(starts):
                    continue
                found = active(pieces, hashes, lang, since, scan, shards, longest)
                ids = None
                if scan < shards:
                    # All words are counted, so they are taken out of the text together.
                    listed = data.replace(BORDER, b" ").split()
                    ids = np.fromiter(map(numbers.__getitem__, listed), np.int64, len(listed))
                    counted_ids.append(ids)
                used = np.unique(np.concatenate([at + j for length, at in found.items() for j in range(length)])) if ids is None else None
                if used is not None and len(used):
                    # Few phrases are active in later scans: only their words are taken out.
                    ids = np.full(len(starts), -1, np.int64)
                    ids[used] = np.fromiter((numbers[data[a:b]] for a, b in zip(starts[used].tolist(), ends[used].tolist())), np.int64, len(used))
                for length, at in found.items():
                    if len(at):
                        places.setdefault((lang, length), []).append(np.stack([ids[at + j] for j in range(length)], 1))
                        n_places += len(at) * length // 2
            if counted_ids:
                n = np.bincount(np.concatenate(counted_ids), minlength=len(numbers.words))
                totals[lang] = totals.get(lang, 0) + int(n.sum())
                n[: len(words.get(lang, ()))] += words.get(lang, n[:0])
                words[lang] = n

        def flush():
            nonlocal numbers, n_places
            known = pa.array(numbers.words, pa.binary())
            for lang, n in words.items():
                ids = np.flatnonzero(n)
                yield made(lang, known.take(pa.array(ids)), n[ids])
            for (lang, length), rows in places.items():
                found, n = counted(rows, length)
                yield made(lang, pc.binary_join_element_wise(*[known.take(pa.array(found[:, j])) for j in range(length)], b" "), n)
            for lang, n in totals.items():
                yield made(lang, pa.array([b""], pa.binary()), np.array([n]))
            for kept in (places, words, totals):
                kept.clear()
            n_places = 0
            if len(numbers.words) > WORDS:
                numbers = Numbers()

        def made(lang, text, n):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), text.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                full = [lang] if sizes[lang] >= BLOB else list(held) if sum(sizes.values()) >= HELD else []
                for one in full:
                    take(one)
                if n_places >= POSITIONS or len(numbers.words) > WORDS:
                    yield from flush()
        for one in list(held):
            take(one)
        yield from flush()

    return documents.select("lang", "data").mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bits_of(slots_found: DataFrame, slots: int) -> np.ndarray:
    """Whether a slot is among those of the rows: bits are gathered by words of 64, so at most ``slots / 64`` rows reach the driver."""
    found = slots_found.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(slots // 64, "<i8")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def reached_slots(phrases: DataFrame, slots: int) -> DataFrame:
    """The slots of phrases by the hash that scans use."""

    def run(batches):
        for batch in batches:
            found = batch.column(1).to_pylist()
            starts, _, pieces, hashes = placed_words(BORDER.join(p.encode() for p in found))
            # The words of the n-th phrase are those of the n-th piece.
            first = np.searchsorted(pieces, np.arange(len(found) + 1))
            out = []
            for lang, a, b in zip(batch.column(0).to_pylist(), first, first[1:]):
                h = started(lang, hashes[a : a + 1])
                for j in range(a + 1, b):
                    h = longer(h, hashes[j : j + 1])
                out.append(int(slots_of(h, slots)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["slot"])

    return phrases.select("lang", "phrase").mapInArrow(run, "slot long")


def _slot(slots: int) -> Column:
    return F.xxhash64("lang", "phrase").bitwiseAND(F.lit(slots - 1))


def frequent(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """All phrases of ``longest`` words at most with their counts from ``threshold`` on, and the words of each language."""
    if not (1 <= shards < 16 and slots & (slots - 1) == 0 and slots >= 64):
        raise ValueError("15 shards at most, and a power of two of slots, are needed")
    context = documents.sparkSession.sparkContext
    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"), F.col(key).alias("key"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", F.octet_length("data")), F.lit(shards)))
    reached = np.full(slots, NEVER, np.uint8)
    strong = np.zeros(slots, bool)
    scans: list[DataFrame] = []
    last, scan = -1, 0

    def sums(parts: list[DataFrame], use):
        """What ``use`` makes of the phrases whose counts over some scans come to the threshold."""
        table = context.broadcast(zlib.compress(np.packbits(strong).tobytes(), 1))
        out = use(over(parts, table, threshold, slots))
        table.destroy()
        return out

    while scan < shards or scan <= last + shards:
        part = rows.filter(F.col("shard") == scan % shards)
        table = context.broadcast(zlib.compress(reached.tobytes(), 1))
        scans.append(written(scanned(part, table, scan, shards, longest), f"phrases-{scan}"))
        table.destroy()
        # Nobody comes to the threshold over that many shards without this much in one of them.
        strong |= bits_of(scans[-1].filter((F.col("phrase") != "") & (F.col("n") >= -(-threshold // shards))).select(_slot(slots).alias("slot")), slots)
        # What is counted in this scan was begun less than a cycle ago.
        new = sums(scans[-shards:], lambda found: bits_of(reached_slots(found.filter(n_words(F.col("phrase")) < longest), slots), slots)) & (reached == NEVER)
        if new.any():
            reached[new], last = scan, scan
        scan += 1
    totals = union(scans[:shards]).filter("phrase = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    return sums(scans, lambda found: written(found, "phrase-counts")), totals


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def over(scans: list[DataFrame], table, threshold: int, slots: int) -> DataFrame:
    """Phrases whose counts over some scans come to the threshold.

    ``table`` has the bits of the phrases that are strong in some scan; what shares no slot
    with them leaves before the exchange, what does by chance is summed as well.
    """

    @F.pandas_udf("boolean")
    def strong(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(table.value), np.uint8)).astype(bool)
        for place in places:
            yield pd.Series(bits[place.to_numpy()])

    rows = union(scans).filter("phrase <> ''").withColumn("slot", _slot(slots)).filter(strong("slot"))
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= threshold)


def n_words(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1


def score(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 * a * n / (l * r)), exactly."""
    a, n, l, r = (F.col(c).cast("decimal(19,0)") for c in (a, n, l, r))
    over_ = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", over_.cast("decimal(38,0)"), (l * r).cast("decimal(38,0)"))


def _salted(phrase: Column, part: Column) -> Column:
    """Short phrases are parts of very many others; rows that look them up are dealt out."""
    return F.when(n_words(part) == 1, F.pmod(F.xxhash64(phrase), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))


def collocations(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", best: int = BEST, longest: int = LONGEST, **options) -> DataFrame:
    """The best ``best`` phrases of each language by their lowest-scoring cut: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    counts, totals = frequent(documents, key, text, lang, longest=longest, **options)
    chosen = counts.filter(n_words(F.col("phrase")) >= 2)
    # A phrase inside a longer one of equal count goes; if any longer one does so, then one that is a word longer.
    inner = chosen.filter(n_words(F.col("phrase")) >= 3).select(
        "lang", "a", F.explode(F.array(F.regexp_replace("phrase", " [^ ]+$", ""), F.regexp_replace("phrase", "^[^ ]+ ", ""))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    chosen = chosen.join(inner, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (F.col("inside") < F.col("a"))).drop("inside")
    words = F.split("phrase", " ")
    cuts = chosen.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " "))
    salts = F.when(n_words(F.col("phrase")) == 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    parts = counts.withColumn("salt", F.explode(salts))
    for name, count in (("first", "l"), ("rest", "r")):
        part = parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count), "salt")
        cuts = cuts.withColumn("salt", _salted(F.col("phrase"), F.col(name))).join(part, ["lang", name, "salt"])
    # All rows of a language meet one row, so they are dealt out as well.
    all_words = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).join(all_words, ["lang", "salt"])

    cuts = cuts.withColumn("score", score("a", "n", "l", "r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each of many parts of a language, then of those.
    dealt = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS)))
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("nth") <= best)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (
    SELECT lang, unnest(flatten([[[array_to_string(words[i:i + k - 1], ' '), CAST(k AS VARCHAR)] FOR i IN range(1, len(words) - k + 2)] FOR k IN [1, 2, 3, 4, 5]])) AS g
    FROM w WHERE len(words) > 0
),
f AS (SELECT lang, g[1] AS phrase, CAST(g[2] AS INTEGER) AS k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS words FROM f WHERE k >= 2 AND a >= 100),
inner_ AS (
    SELECT DISTINCT c.lang, c.phrase FROM c JOIN c o ON o.lang = c.lang AND o.k > c.k AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')
),
cut AS (
    SELECT c.*, x.i, array_to_string(words[1:x.i], ' ') AS first, array_to_string(words[x.i + 1:], ' ') AS rest
    FROM c JOIN range(1, 5) x(i) ON x.i < c.k WHERE NOT EXISTS (SELECT 1 FROM inner_ z WHERE z.lang = c.lang AND z.phrase = c.phrase)
),
s AS (
    SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n.n, cut.i,
           CAST((CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.first JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rest JOIN n ON n.lang = cut.lang
),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM s),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m WHERE nth = 1)
SELECT * FROM o WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
