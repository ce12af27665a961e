"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of
vote patterns estimates how often each rule is right; a document's verdict is its
posterior probability of being good, not the conjunction of all rules.

Defined results: a null or empty text has no words, fails the base rules and gets
the posterior of its votes; rows are judged one by one, so repeated rows and equal
ids give repeated results; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.operators.lineage import written

# White space between words, symbols counted, and the limits of the rules.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule -> (good where, bad where); neither: the rule abstains. Most rules know only bad signs: passing them tells nothing.
RULES = {
    "length": ("n_words >= 80", f"n_words < {MIN_WORDS}"),
    "sentences": ("n_stops * 60 >= n_words and n_stops * 2 <= n_words", "n_stops * 200 < n_words"),
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    "symbols": ("false", "n_symbols * 10 > n_words"),
    "letters": ("false", "n_letters * 100 < 80 * word_chars or word_chars = 0"),
    "dup_lines": ("false", "n_dup_lines * 4 > n_lines"),
    "repeats": ("false", "n_repeat_words * 100 > 30 * n_words"),
    "variety": ("false", "n_distinct_words * 100 < 20 * n_words or n_words = 0"),
}

#: Votes in the order of the tables below.
VOTES = (-1, 0, 1)
#: A rule's votes by class and the share of good documents before any data; they count as WEIGHT times the corpus.
PRIOR = {True: (0.01, 0.39, 0.60), False: (0.30, 0.30, 0.40)}
SHARE = 0.9
WEIGHT = 0.5
#: A rule votes bad on at most this share of good documents; this keeps the two classes from changing places.
MAX_FALSE_ALARMS = 0.02


def _window(words: Column, i: Column) -> Column:
    return F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _twins(rows: Column, key) -> Column:
    """Rows of a sorted array whose key a neighbour shares."""

    def same(x, j):
        return F.coalesce(key(x) == key(F.get(rows, j)), F.lit(False))

    return F.filter(rows, lambda x, j: same(x, j - 1) | same(x, j + 1))


def base_counts(documents: DataFrame, hash_bits: int = 43) -> DataFrame:
    """The counts that the rules read, one row per document.

    ``hash_bits`` is the part of a window's hash that is sorted; it changes the speed
    only, since clashing windows are compared in full.
    """
    df = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("body", F.trim(F.col("text"), F.lit(SPACE)))
    df = df.withColumn("words", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", SPACES)))
    words, low = F.col("words"), 64 - hash_bits
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    # Windows sorted as plain longs: part of the hash, then the position.
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), low).bitwiseOR(i.cast("long")))
    df = df.withColumn("sorted", F.when(F.size(words) >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))

    def code(x):
        return F.shiftright(x, low)

    def position(x):
        return x.bitwiseAND(F.lit((1 << low) - 1)).cast("int")

    df = df.withColumn("twins", _twins(F.col("sorted"), code))
    twins = F.col("twins")
    # Neighbours of one hash with different words, or positions that need more bits: sort the windows themselves.
    clash = F.transform(twins, lambda x, j: (code(x) == code(F.get(twins, j - 1))) & (_window(words, position(x)) != _window(words, position(F.get(twins, j - 1)))))
    df = df.withColumn("odd", (F.size(words) >= (1 << min(low, 30))) | F.exists(clash, lambda x: F.coalesce(x, F.lit(False))))
    df = df.withColumn("ordered", F.when(F.col("odd"), F.array_sort(F.transform(starts, lambda i: F.struct(_window(words, i).alias("w"), i.alias("i"))))))
    exact = F.transform(_twins(F.col("ordered"), lambda x: x["w"]), lambda x: x["i"])
    df = df.withColumn("at", F.sort_array(F.when(F.col("odd"), exact).otherwise(F.transform(twins, position))))
    at = F.col("at")
    covered = F.aggregate(
        F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(3), x - F.get(at, j - 1)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != ""))

    def found(text, pattern):
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    df = df.withColumn("joined", F.array_join("words", ""))
    return df.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        found("text", SYMBOLS).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        found("joined", r"[.!?]").alias("n_stops"), found("joined", r"\p{L}").alias("n_letters"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )


def votes(counts: DataFrame) -> DataFrame:
    """A column ``vote_<rule>`` per rule: 1 good, -1 bad, 0 abstains."""
    return counts.withColumns({f"vote_{k}": F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for k, (good, bad) in RULES.items()})


def vote_rates(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[bool, tuple[float, ...]]]]:
    """Share of good documents and each rule's votes given the class, by expectation-maximisation.

    A rule's accuracy on good documents and on bad ones are two figures, since passing
    a rule says little where failing it says much. ``patterns`` holds votes with their
    number of documents: at most 3 ** rules rows, however large the corpus.
    """
    n, size = len(RULES), WEIGHT * max(1, sum(count for _, count in patterns))
    share, rates = SHARE, [dict(PRIOR) for _ in RULES]
    for _ in range(rounds):
        mass = {True: size * SHARE, False: size * (1 - SHARE)}
        seen = [{y: [mass[y] * x for x in PRIOR[y]] for y in PRIOR} for _ in range(n)]
        for vote, count in patterns:
            p = posterior(vote, share, rates)
            for y, weight in ((True, p * count), (False, (1 - p) * count)):
                mass[y] += weight
                for j, v in enumerate(vote):
                    seen[j][y][v + 1] += weight
        before, share = share, mass[True] / sum(mass.values())
        rates = [{y: tuple(x / sum(s[y]) for x in s[y]) for y in s} for s in seen]
        for r in rates:
            alarms = min(r[True][0], MAX_FALSE_ALARMS)
            rest = (1 - alarms) / (1 - r[True][0])
            r[True] = (alarms, r[True][1] * rest, r[True][2] * rest)
        if abs(before - share) < 1e-10:
            break
    return share, rates


def weights(share: float, rates: list) -> tuple[float, list[dict[int, float]]]:
    """The log odds of the classes, and what each vote of a rule adds to them; abstaining adds nothing."""
    return math.log(share / (1 - share)), [{v: math.log(r[True][v + 1] / r[False][v + 1]) if v else 0.0 for v in VOTES} for r in rates]


def posterior(vote: tuple[int, ...], share: float, rates: list) -> float:
    """Probability that a document with these votes is good."""
    start, adds = weights(share, rates)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, start + sum(a[v] for a, v in zip(adds, vote))))))


def judge(documents: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """Counts, votes, posterior, ``base_failed`` and ``kept`` of every document."""
    voted = votes(written(base_counts(documents), "rule-counts"))
    names = [f"vote_{k}" for k in RULES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # All documents teach how far each rule can be trusted, those that fail the base rules too.
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    start, adds = weights(*vote_rates(patterns))
    log_odds = F.lit(start)
    for name, add in zip(names, adds):
        log_odds = log_odds + F.when(F.col(name) > 0, add[1]).when(F.col(name) < 0, add[-1]).otherwise(0.0)
    judged = voted.withColumn("posterior", 1 / (1 + F.exp(-log_odds))).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
