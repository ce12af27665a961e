"""Secrets by pattern, and tokens that look random, in DataFrame functions only.

Base spans are secrets by fixed patterns. Of the other long tokens those are added that a
battery of randomness tests lets through and that ordinary text would hardly give:

* The encoding of a token is inferred: the smallest of the known alphabets that holds it.
* Battery, against "every symbol of that alphabet is equally likely": the chi-squared
  statistic (a function of the pairs of equal symbols), runs above and below the middle of
  the alphabet, and serial correlation of neighbours. A token that fails is structured.
* Evidence, against "ordinary text": it has fewer pairs of equal symbols than text has by
  its index of coincidence, or more changes between digits, capitals, small letters and
  signs. Both are tails in the token's length, so a short token gives little evidence.
* False discoveries are controlled by the rule of Benjamini and Hochberg over the different
  tokens of all documents, within classes of encoding and length, so that the many short
  tokens do not decide about the long ones. A token that fails the battery counts as a test
  with p = 1. All tails are bounds (Chernoff's), never less than the exact ones.

What goes to the driver are counts by class and rounded p-value: at most ``CELLS`` rows.

Defined results: a null text counts as empty and has no spans; rows are scanned one by one,
so repeated rows and equal or null keys give repeated results; tokens that touch a base
span, a letter or a digit outside ASCII are not judged; copies of a token count once in the
control and are found wherever they stand; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.operators.lineage import written

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: These two ask for the least length at once: what follows a start that is too short is too short itself, so the same matches drop.
ACCESS = rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}+"
HEX = rf"[0-9a-f]{{{MIN_HEX},}}+"

#: Tokens that the battery judges: long runs of the letters of encodings, with what pads them.
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![\p{L}\p{N}])"
DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIGNS = "+/-_"
#: Encodings by growing alphabet: the first that holds a token is its encoding.
ENCODINGS = {
    "digits": DIGITS, "hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "small": SMALL, "capitals": CAPITALS,
    "base32": CAPITALS + "234567", "base36": DIGITS + SMALL, "BASE36": DIGITS + CAPITALS, "letters": CAPITALS + SMALL,
    "base62": DIGITS + CAPITALS + SMALL, "base64": DIGITS + CAPITALS + SMALL + "+/", "base64url": DIGITS + CAPITALS + SMALL + "-_",
    "mixed": DIGITS + CAPITALS + SMALL + SIGNS,
}
#: Chance that two, and that three letters of ordinary text are equal (its index of coincidence lies between 0.066 and
#: 0.078 in European languages; less is taken, since names mix cases), and how often neighbours differ in class at most.
COINCIDENCE, COINCIDENCE3, CHANGES = 0.06, 0.005, 0.2
#: A token whose battery gives less is structured; the share of added spans that may be ordinary.
STRUCTURED, FALSE_SHARE = 0.01, 0.05
#: p-values are rounded up to tenths of a power of ten, down to 1e-60; lengths to half powers of two.
TENTHS, LAST = 10, 600
CELLS = len(ENCODINGS) * 64 * (LAST + 1)

SPAN = "array<struct<start:bigint,end:bigint>>"


def _places(hits: Column, gaps: Column) -> Column:
    """Start and end of each match in code points, from what stands between them; k matches take k ** 1.5 steps."""

    def total(rows):
        return F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["gap"] + r["hit"])

    def build(pairs):
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, size), lambda i: total(F.slice(pairs, i + 1, size)))
        before = F.transform(blocks, lambda _, j: F.aggregate(F.slice(blocks, F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x))

        def place(known):
            def one(r, i):
                block = F.floor(i / known["size"]).cast("int")
                start = F.get(known["before"], block) + total(F.slice(pairs, block * known["size"] + 1, i % known["size"])) + r["gap"]
                return F.struct(start.alias("start"), (start + r["hit"]).alias("end"))

            return F.transform(pairs, one)

        return F.transform(F.array(F.struct(before.alias("before"), size.alias("size"))), place)[0]

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
    return F.when(F.size(hits) > 0, F.transform(F.array(pairs), build)[0]).otherwise(F.array().cast(SPAN))


def _found(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Columns ``<name>_hits`` and ``<name>_gaps``: the matches and what stands between them."""
    hits = F.col(f"{name}_hits")
    df = df.withColumn(f"{name}_hits", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return df.withColumn(f"{name}_gaps", F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array(F.col(text))))


def base_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the base spans ``assign``, ``access`` and ``hex``, and ``rest``, the text without them in the same places."""
    df = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = _found(df, "assign", "text", ASSIGN)
    values = F.when(F.size("assign_hits") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("values", values).withColumn("all", _places(F.col("assign_hits"), F.col("assign_gaps")))
    df = df.withColumn("assign", F.filter("all", lambda _, i: F.length(F.get("values", i)) >= MIN_ASSIGNED))
    rest = F.col("text")
    df = _found(df, "access", "text", ACCESS)
    df = df.withColumn("access", _places(F.col("access_hits"), F.col("access_gaps")))
    df = _found(df, "hex", "text", HEX)
    df = df.withColumn("hex", _places(F.col("hex_hits"), F.col("hex_gaps")))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        rest = F.when(F.size(f"{name}_hits") > 0, _overwritten(rest, pattern)).otherwise(rest)
    return df.select("key", "assign", "access", "hex", rest.alias("rest"))


def _overwritten(text: Column, pattern: str) -> Column:
    """A text with the matches of a pattern overwritten by letters outside ASCII, so that nothing beside them is a token."""

    def build(t):
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), hits, lambda g, h: F.concat(g, F.repeat(F.lit("ª"), F.coalesce(F.length(h), F.lit(0))))), "")

    return F.transform(F.array(text), build)[0]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bound(distance: Column) -> Column:
    """A two-sided tail from its exponent."""
    return F.least(F.lit(1.0), 2 * F.exp(-distance))


def _divergence(share: Column, rate: float) -> Column:
    """Relative entropy of two coins."""
    def term(p, q):
        return F.when(p > 0, p * F.log(p / q)).otherwise(0.0)

    return term(share, F.lit(rate)) + term(1 - share, F.lit(1 - rate))


def _encoding(token: Column) -> Column:
    """The name and the alphabet of the smallest encoding that holds a token."""
    out = None
    for name, letters in ENCODINGS.items():
        known = F.struct(F.lit(name).alias("name"), F.lit(letters).alias("letters"))
        # Letters alone are no digits-and-letters code, and base32 words need one of its digits.
        holds = F.call_function("translate", token, F.lit(letters), F.lit("")) == ""
        if name in ("hex", "HEX", "base32", "base36", "BASE36"):
            holds = holds & token.rlike("[0-9]")
        out = F.when(holds, known) if out is None else out.when(holds, known)
    return out


def _runs(token: Column, letters: Column, marks: Column) -> Column:
    """Runs of equal marks when each letter is replaced by its mark."""
    return F.length(F.regexp_replace(F.call_function("translate", token, letters, marks), r"(.)\1*+", "$1")).cast("double")


def tests(token: Column) -> Column:
    """Encoding, length, battery and evidence of one token, as a struct."""

    def measured(t):
        # t: the token without padding, its encoding, and its letters.
        body, letters, chars = t["body"], t["encoding"]["letters"], t["chars"]
        n, size = F.size(chars).cast("double"), F.length(t["encoding"]["letters"]).cast("double")
        often = F.transform(F.array_distinct(chars), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"))
        equal = F.aggregate(often, F.lit(0.0), lambda a, k: a + k * (k - 1) / 2)
        places = F.transform(chars, lambda c: F.position(c, letters).cast("double"))
        # Places in the alphabet less their mean, which is taken once.
        codes = _let(F.struct(places.alias("x"), (_total(places) / n).alias("mean")), lambda k: F.transform(k["x"], lambda x: x - k["mean"]))
        half = F.concat(F.repeat(F.lit("a"), (size / 2).cast("int")), F.repeat(F.lit("b"), (size / 2).cast("int")))
        return F.struct(
            n.alias("n"), size.alias("size"), equal.alias("equal"), codes.alias("codes"), (_runs(body, letters, half) - 1).alias("halves"),
            (_runs(body, F.lit(DIGITS + CAPITALS + SMALL + SIGNS), F.lit("d" * 10 + "u" * 26 + "l" * 26 + "s" * 4)) - 1).alias("changes"),
        )

    def judged(m):
        n, size, equal = m["n"], m["size"], m["equal"]
        pairs = n * (n - 1) / 2
        mean = pairs / size
        # Battery: equal pairs as a Poisson number, changes of half as coins, neighbours as a normal correlation.
        uniform = _bound(F.when(equal > 0, equal * F.log(equal / mean)).otherwise(0.0) - equal + mean)
        runs = _bound((n - 1) * _divergence(m["halves"] / (n - 1), 0.5))

        codes = m["codes"]
        spread = _total(F.transform(codes, lambda x: x * x))
        together = _total(F.zip_with(F.slice(codes, F.lit(1), (n - 1).cast("int")), F.slice(codes, F.lit(2), (n - 1).cast("int")), lambda x, y: x * y))
        serial = F.when(spread > 0, _bound(n * (together / spread) * (together / spread) / 2)).otherwise(0.0)
        battery = F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))
        # Evidence against ordinary text.
        usual = pairs * COINCIDENCE
        variance = pairs * (COINCIDENCE - COINCIDENCE**2) + pairs * (n - 2) * 2 * (COINCIDENCE3 - COINCIDENCE**2)
        fewer = F.when(equal < usual, F.exp(-(usual - equal) * (usual - equal) / variance / 2)).otherwise(1.0)
        share = m["changes"] / (n - 1)
        more = F.when(share > CHANGES, F.exp(-(n - 1) * _divergence(share, CHANGES))).otherwise(1.0)
        return F.struct(battery.alias("battery"), F.least(F.lit(1.0), 2 * F.least(fewer, more)).alias("evidence"))

    body = F.rtrim(token, F.lit("="))
    known = _let(F.struct(body.alias("body"), _encoding(body).alias("encoding"), F.split(body, "").alias("chars")), lambda t: F.struct(t["encoding"]["name"].alias("encoding"), measured(t).alias("m")))
    return _let(known, lambda k: F.struct(k["encoding"].alias("encoding"), k["m"]["n"].cast("long").alias("n"), judged(k["m"]).alias("p")))


def candidates(rest: DataFrame) -> DataFrame:
    """For each row of ``base_spans`` its judged tokens: place, class, rounded p-value and the token's hash."""
    df = _found(rest, "token", "rest", TOKEN).withColumn("at", _places(F.col("token_hits"), F.col("token_gaps")))

    def one(token, i):
        def told(x):
            p = F.when(x["p"]["battery"] >= STRUCTURED, x["p"]["evidence"]).otherwise(1.0)
            # Rounded so that the p-value taken is never less than the one measured.
            cell = F.least(F.lit(LAST), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * TENTHS)).cast("int")
            place = F.get(F.col("at"), i)
            return F.struct(
                place["start"].alias("start"), place["end"].alias("end"), x["encoding"].alias("encoding"), F.floor(F.log2(x["n"]) * 2).cast("int").alias("length"),
                F.greatest(F.lit(0), cell).alias("cell"), F.xxhash64(token).alias("token"),
            )

        return F.transform(F.array(tests(token)), told)[0]

    return df.select("key", "assign", "access", "hex", F.transform("token_hits", one).alias("tokens"))


def limits(judged: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[str, int], int]:
    """For each class of encoding and length the least cell whose tokens are added, where there is one."""
    tokens = judged.select(F.explode("tokens").alias("t")).select("t.encoding", "t.length", "t.cell", "t.token").distinct()
    counts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in tokens.groupBy("encoding", "length", "cell").count().collect():
        counts.setdefault((r["encoding"], r["length"]), []).append((r["cell"], r["count"]))
    out = {}
    for stratum, cells in counts.items():
        tests_made, reached = sum(n for _, n in cells), 0
        for cell, n in sorted(cells, reverse=True):
            reached += n
            if tests_made * 10 ** (-cell / TENTHS) <= false_share * reached:
                out[stratum] = cell
    return out


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """``key``, the base spans by kind and the added spans ``random`` with their encoding, one row per row."""
    judged = written(candidates(base_spans(documents, key, text)), "secret-tokens")
    least = limits(judged, false_share)
    # At most one entry per encoding and class of length.
    table = F.create_map(*[F.lit(x) for (e, n), cell in sorted(least.items()) for x in (f"{e}:{n}", cell)]) if least else F.lit(None).cast("map<string,int>")

    def added(t):
        limit = F.try_element_at(table, F.concat_ws(":", t["encoding"], t["length"]))
        return F.coalesce(t["cell"] >= limit, F.lit(False))

    spans = F.transform(F.filter("tokens", added), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding")))
    return judged.select(F.col("key").alias(key), "assign", "access", "hex", spans.alias("random"))


@query("op12_secret_scan")
def op12_secret_scan(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def sortable(i, kind):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("at"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def listed(kinds):
        spans = F.array_sort(F.concat(*[sortable(i, k) for i, k in enumerate(kinds)]))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), listed(KINDS).alias("spans")
    )
