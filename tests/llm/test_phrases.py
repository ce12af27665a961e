"""Collocations against a plain count of everything."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import phrases


def plain_counts(rows, longest=5):
    f = collections.Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", *words[i : i + k]] += 1
    return f


def plain_report(rows, threshold, best, longest=5):
    f = plain_counts(rows, longest)
    n = collections.Counter()
    for (lang, *words), c in f.items():
        n[lang] += c * (len(words) == 1)
    candidates = {p: c for p, c in f.items() if len(p) > 2 and c >= threshold}
    out = collections.defaultdict(list)
    for (lang, *words), a in candidates.items():
        inside = any(
            o[0] == lang and len(o) > len(words) + 1 and c >= a and any(list(o[i : i + len(words)]) == words for i in range(1, len(o) - len(words) + 1))
            for o, c in candidates.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])
    )


def made(n=400, seed=4):
    rnd = random.Random(seed)
    words = ["the", "The", "a", "of", "é", "É", "x\x85y", "　", "b\x1cc", "New", "York", "city", "\U0001f600", "-", "of the"] + [f"w{i}" for i in range(30)]
    stock = ["New York city hall", "a a a a a a a", "of the of the of the", "once upon a time", "w1 w2 w3 w4 w5 w6"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 12)):
            parts.append(rnd.choice(stock) if rnd.random() < 0.25 else rnd.choice(words))
            parts.append(rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b "]))
        rows.append((i, "".join(parts), rnd.choice(["en", "en", "de", None, "und"])))
    return rows + [(0, None, "en"), (None, "", "fr"), (None, "Once upon a time", None), (None, "Once upon a time", None), (7, "z " * 3000, "long")]


@pytest.mark.parametrize("options", [{"threshold": 3, "shards": 1}, {"threshold": 5, "shards": 3, "slots": 64}, {"threshold": 12, "shards": 2, "best": 4, "longest": 3}])
def test_equals_a_plain_count(spark, options, monkeypatch):
    # Blobs, memories and gathered places of a few entries, so that every border of theirs is met.
    for name, size in (("BLOB", 300), ("SEGMENT", 80), ("HELD", 700), ("WORDS", 40), ("POSITIONS", 100)):
        monkeypatch.setattr(phrases, name, size)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit(1) for c in ("key", "data", "phrase", "n", "a", "k", "salt", "shard", "rank")})
    got = phrases.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    wanted = plain_report(rows, options["threshold"], options.get("best", 2000), options.get("longest", 5))
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 5


def test_counts_are_exact_where_all_slots_are_shared(spark):
    rows = made(150, seed=9)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, totals = phrases.frequent(df, threshold=4, shards=2, slots=64)
    f = plain_counts(rows)
    assert {(r.lang, *r.phrase.split(" ")): r.a for r in counts.collect()} == {p: c for p, c in f.items() if c >= 4}
    assert sum(r.n for r in totals.collect()) == sum(c for p, c in f.items() if len(p) == 2)


def test_scores_pass_64_bits(spark):
    rows = [(10**13 + 7, 10**14 + 9, 10**9 + 1, 10**9 + 3), (7, 3, 2, 5), (10**12, 10**16 - 1, 999_999_937, 999_999_929)]
    got = [r.s for r in spark.createDataFrame(rows, "a long, n long, l long, r long").coalesce(1).select(phrases.score("a", "n", "l", "r").alias("s")).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(df).count() == 0


def test_phrases_of_rows_of_numbers():
    rnd = np.random.default_rng(1)
    for length in range(2, 6):
        rows = rnd.integers(0, 3, (500, length))
        found, n = phrases.counted([rows[:200], rows[200:]], length)
        assert {tuple(map(int, f)): int(c) for f, c in zip(found, n)} == collections.Counter(tuple(map(int, r)) for r in rows)
