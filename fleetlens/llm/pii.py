"""Personal data, and the terms that give it away.

Base spans are personal data by fixed patterns. The corpus then tells how strongly the
terms around a value reveal it: with IC(e) = -log p(e) and the pointwise mutual
information of term and value over documents, the disclosure of a term is PMI / IC =
1 + log p(e | term) / IC, which is 1 where the term never occurs without the value.
For p(e | term) stands the lower end of its confidence interval, so that a pair is judged by
as much as is known of it. The context in which a value is met first is no evidence for the
next one: a term that stands with a value in one context only discloses nothing, in a corpus
of any size. Values are judged alone
and pooled: addresses by domain, IP addresses by network, card and phone numbers by their
first digits. Terms are whole words of any length; one occurs with a value wherever both
stand in the document. Terms whose disclosure exceeds a threshold are generalised, those
beyond a second one are removed, in every document and wherever they stand in it.

A pair can only reach the threshold if the term occurs in no more documents than the value
has, plus what the value's contexts make up for; terms beyond that bound are not paired.

Defined results: a null text counts as empty and has no spans; repeated rows get equal
spans each, and rows that share an id are told apart by their text; contexts of a value are
told apart by the ``WINDOW`` terms within ``REACH`` characters on either side of its first
mention in a document, so copies of a passage around it count once as evidence; columns
besides the key and the text are passed on by ``sanitise`` and ignored by ``find``; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.operators.lineage import written

# The kinds in their order, and their patterns; a digit run that fails is not tried again from its middle.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"\b[\d_]*[^\W\d_]\w*")

#: Terms on either side of a mention that name its context, and the characters in which they are looked for.
WINDOW, REACH = 8, 160
#: Standard deviations between the share of a value in a term's occurrences and the lower end that is taken for it.
CONFIDENCE = 1.96
#: First digits that pool card and phone numbers.
PREFIX = 6
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Terms counted by a task before it hands them on; bounds memory only.
COUNTED = 200_000
#: Most frequent terms that tasks know with their counts before terms are paired; bounds memory only.
FREQUENT = 100_000
#: Pairs that a task holds before it hands them on; bounds memory only.
PAIRED = 200_000
#: Bits of the filter that tells most other terms from disclosing ones before the join: 4 MB, which bounds memory only.
FILTER = 1 << 25


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of personal data by pattern, by start and kind."""
    found = [(a, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and passes_luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def value_of(kind: str, text: str) -> str:
    """What equal mentions of one value share."""
    return f"{kind}:{text.lower() if kind == 'email' else ''.join(c for c in text if c.isdigit() or c == '.') if kind == 'ip' else ''.join(c for c in text if c.isdigit())}"


def entities_of(kind: str, text: str) -> tuple[str, str]:
    """The value of a mention and the pool it belongs to."""
    value = value_of(kind, text)
    if kind == "email":
        return value, f"domain:{value.rpartition('@')[2]}"
    if kind == "ip":
        return value, f"network:{value.removeprefix('ip:').rpartition('.')[0]}"
    return value, f"{kind}-prefix:{value.removeprefix(kind + ':')[:PREFIX]}"


def terms_of(text: str) -> set[str]:
    return {m.lower() for m in TERM.findall(text)}


def contexts(text: str, spans: list[tuple[int, int, str]]) -> dict[str, int]:
    """For each value and pool of a text a name of the context in which it stands first."""
    out: dict[str, int] = {}
    for a, b, kind in spans:
        near = [m.group().lower() for m in TERM.finditer(text, max(0, a - REACH), a)][-WINDOW:]
        near += [m.group().lower() for m in TERM.finditer(text, b, min(len(text), b + REACH))][:WINDOW]
        name = hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest()
        for entity in entities_of(kind, text[a:b]):
            out.setdefault(entity, int.from_bytes(name, "little", signed=True))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
ENTITY = pa.struct([("value", pa.string()), ("context", pa.int64())])
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def text_key(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


def mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text_key``, base spans, values with their contexts and, where there are any, the terms, one row per document."""

    def run(batches):
        for batch in batches:
            keys, spans, entities, terms = [], [], [], []
            for value in batch.column(1).to_pylist():
                t = value or ""
                found = base_spans(t)
                keys.append(text_key(t))
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                entities.append([{"value": v, "context": c} for v, c in contexts(t, found).items()])
                terms.append(sorted(terms_of(t)) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(spans, pa.list_(SPAN)), pa.array(entities, pa.list_(ENTITY)), pa.array(terms, pa.list_(pa.string()))],
                ["key", "text_key", "base", "entities", "terms"],
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text_key binary, base {SPANS}, entities array<struct<value:string,context:bigint>>, terms array<string>")


def term_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``term`` and ``n``: in how many documents each term occurs, over whole texts."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts.update(terms_of(value or ""))
                if len(counts) > COUNTED:
                    yield flush()
        if counts:
            yield flush()

    return documents.select(F.col(text).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lower_share(k, n, z: float = CONFIDENCE):
    """The lower end of Wilson's interval for a share of which ``k`` of ``n`` are seen."""
    share = k / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def judged_values(seen: DataFrame, n_docs: int, generalise: float = GENERALISE) -> DataFrame:
    """Values that any term can disclose: ``value``, ``n_value``, and ``bound``, in how many documents such a term occurs at most."""
    held = seen.select(F.explode("entities").alias("e")).groupBy("e.value", "e.context").agg(F.count("*").alias("n"))
    values = held.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("contexts"))
    # p >= (n_value / n_docs) ** (1 - threshold) is needed, p <= k / (k + others), k <= contexts and others >= n_term - n_value.
    least = F.pow(F.col("n_value") / F.lit(n_docs), F.lit(1 - generalise))
    bound = F.col("n_value") + F.col("contexts") * (1 / least - 1)
    return values.filter((F.col("contexts") >= 2) & (F.col("n_value") < n_docs)).select("value", "n_value", F.ceil(bound).alias("bound"))


def paired(seen: DataFrame, values: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """``value``, ``term``, ``context`` and ``n`` of pairs that may reach the threshold, counted by task.

    ``frequent`` has the counts of some terms; what it leaves out is paired.
    """
    shared = seen.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([k[2] for k in counts], pa.int64()), pa.array(counts.values(), pa.int64())],
                ["value", "term", "context", "n"],
            )
            counts.clear()
            return out

        for batch in batches:
            for entities, terms, n in zip(*(c.to_pylist() for c in batch.columns)):
                often = [shared.value.get(t, 0) for t in terms]
                for e in entities:
                    value, context, bound = e["value"], e["context"], e["bound"]
                    for t, m in zip(terms, often):
                        if m <= bound:
                            counts[value, t, context] += n
                    if len(counts) > PAIRED:
                        yield flush()
        if counts:
            yield flush()

    texts = seen.filter(F.size("entities") > 0).groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms"), F.count("*").alias("n"))
    # Only names and numbers are joined; the terms of a text stay where they are until the last step.
    texts = written(texts, "texts")
    told = texts.select("text_key", F.explode("entities").alias("e")).select("text_key", "e.value", "e.context").join(values, "value")
    told = told.groupBy("text_key").agg(F.collect_list(F.struct("value", "context", "bound")).alias("told"))
    rows = texts.join(told, "text_key").select("told", "terms", "n")
    return rows.mapInArrow(run, "value string, term string, context long, n long")


def frequent_terms(terms: DataFrame, size: int = FREQUENT) -> dict[str, int]:
    """Terms with their counts, from the least power of two on that no more than ``size`` of them reach."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    per_power = sorted(((r[0], r[1]) for r in terms.groupBy(power.alias("p")).count().collect()), reverse=True)
    least, held = None, 0
    for p, n in per_power:
        held += n
        if held > size:
            break
        least = p
    return {} if least is None else {r["term"]: r["n"] for r in terms.filter(power >= least).collect()}


def disclosures(seen: DataFrame, documents: DataFrame, text: str = "text", confidence: float = CONFIDENCE, generalise: float = GENERALISE) -> DataFrame:
    """``value``, ``term`` and ``disclosure`` of the pairs at or above the threshold.

    ``seen`` is the table of ``mentions``. Evidence for a pair are the different contexts
    of the value in documents with the term, two at least, evidence against it the documents
    that have the term without the value.
    """
    n_docs = seen.count()
    values = written(judged_values(seen, n_docs, generalise), "values")
    terms = written(term_counts(documents, text), "terms")
    frequent = frequent_terms(terms, FREQUENT)
    # Rows and copies first, so that nothing but sums goes by value and term.
    pairs = (
        paired(seen, values, frequent).groupBy("value", "term", "context").agg(F.sum("n").alias("n"))
        .groupBy("value", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_both")).filter("contexts >= 2")
    )
    joined = written(pairs, "pairs").join(values, "value").join(terms.withColumnRenamed("n", "n_term"), "term")
    ic = F.log(F.lit(n_docs) / F.col("n_value"))
    given = lower_share(F.col("contexts"), F.col("contexts") + F.greatest(F.col("n_term") - F.col("n_both"), F.lit(0)), confidence)
    return joined.withColumn("disclosure", 1 + F.log(given) / ic).filter(F.col("disclosure") >= generalise).select("value", "term", "disclosure")


def term_filter(terms: DataFrame, size: int = FILTER) -> bytes:
    """A bit for each checksum of a term, of ``size`` bits however many terms there are."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(size))
    words = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("bits"))
    found = words.toArrow()
    out = np.zeros(size // 32, "<u4")
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def occurrences(documents: DataFrame, terms: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text_key``, ``term``, ``start`` and ``end`` of every occurrence outside base spans of a term that the filter lets through."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        bits = shared.value
        size = 8 * len(bits)

        def may_be(term):
            at = zlib.crc32(term.encode()) % size
            return bits[at >> 3] >> (at & 7) & 1

        for batch in batches:
            rows, keys, found, starts, ends = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                t = value or ""
                wanted = {w for w in terms_of(t) if may_be(w)}
                if not wanted:
                    continue
                taken, name, nth = sorted((a, b) for a, b, _ in base_spans(t)), text_key(t), 0
                reached = 0
                for m in TERM.finditer(t):
                    a, b = m.span()
                    # Spans that begin before the term ends; the farthest end of them tells whether one meets it.
                    while nth < len(taken) and taken[nth][0] < b:
                        reached = max(reached, taken[nth][1])
                        nth += 1
                    if a >= reached and (w := m.group().lower()) in wanted:
                        rows.append(i)
                        keys.append(name)
                        found.append(w)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary()), pa.array(found, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["key", "text_key", "term", "start", "end"],
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text_key binary, term string, start long, end long")


def find(documents: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``key``, ``text_key``, ``base`` spans and ``added`` spans with their disclosure, one row per row."""
    seen = written(mentions(documents, key, text), "mentions")
    told = written(disclosures(seen, documents, text, **thresholds).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "told")
    spans = occurrences(documents, term_filter(told), key, text).distinct().join(told, "term")
    added = spans.groupBy("key", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("added"))
    a, b = seen.select("key", "text_key", "base").alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_key") == F.col("b.text_key")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    return joined.select(F.col("a.key").alias(key), "a.text_key", "base", F.coalesce("added", none).alias("added"))


def masked(text: str, base: list, added: list, remove: float = REMOVE) -> str:
    """A text with its spans replaced; a span that overlaps one before it joins it."""
    spans = [(s["start"], s["end"], f"<{s['kind'].upper()}>") for s in base]
    spans += [(s["start"], s["end"], "" if s["disclosure"] >= remove else "<TERM>") for s in added]
    out, reached = [], 0
    for a, b, new in sorted(spans):
        if a >= reached:
            out += [text[reached:a], new]
        reached = max(reached, b)
    done = "".join(out) + text[reached:]
    # What a removed term held apart can read as personal data.
    again = base_spans(done) if added else []
    return masked(done, [{"kind": k, "start": a, "end": b} for a, b, k in again], []) if again else done


def sanitise(documents: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """The rows with their texts masked; a null text stays null."""
    told = find(documents, key, text, **thresholds).filter(F.size("added") > 0).select(F.col(key).alias("told"), "text_key", "added")
    told = told.groupBy("told", "text_key").agg(F.first("added").alias("added"))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, added: pd.Series) -> pd.Series:
        done = [
            None if t is None else masked(t, [{"kind": k, "start": x, "end": y} for x, y, k in base_spans(t)], [] if a is None else list(a))
            for t, a in zip(texts, added)
        ]
        return pd.Series(done, dtype=object)

    @F.pandas_udf("binary")
    def named(texts: pd.Series) -> pd.Series:
        return texts.map(text_key)

    rows = documents.select(F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("whole"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("as", named("text"))
    rows = rows.join(told, F.col("key").eqNullSafe(F.col("told")) & (F.col("as") == F.col("text_key")), "left")
    return rows.withColumn("whole", F.col("whole").withField(f"`{text}`", mask("text", "added"))).select("whole.*")


@query("op1_personal_data")
def op1_personal_data(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    terms = F.transform("added", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, KINDS[:4]), F.size("added").cast("long").alias("n_term"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", terms)).alias("spans"),
    )
