"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of whole texts are transformed to be near normal; each class keeps a mean and
a covariance that is shrunk to the pooled one and to its diagonal. The score is the
difference of the classes' Mahalanobis log densities, by Cholesky factors that are
computed once, put through a logistic.

Defined results: a null text counts as empty and is scored as such; if a class has no
training row, every score is 0.5; labels that are null are left out, and a label counts
once for each row that carries its id; rows are scored one by one, so repeated rows give
repeated results; columns besides the key and the text are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.operators.lineage import written

#: Statistics of a text, in this order.
NAMES = (
    "words", "word_length", "word_spread", "longest_word", "distinct", "symbols", "digits", "capitals", "letters",
    "stops", "shouts", "commas", "lines", "line_length", "dup_lines", "compression",
)
#: Share of the pooled covariance in each class's, and of the diagonal in the result.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
#: Log-density differences are divided by this before the logistic, so that scores keep their order.
TEMPERATURE = 4.0

SYMBOLS, DIGITS, STOPS = b"#*$%&|<>", b"0123456789", b".!?"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, transformed by logarithms of counts and of odds."""
    text = text or ""
    data, words = text.encode(), text.split()
    n = len(words)
    size = max(1, len(data))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    lines = [line for line in text.split("\n") if line.strip()]
    without = {k: len(data) - len(data.translate(None, k)) for k in (SYMBOLS, DIGITS, CAPITALS, SIGNS, STOPS)}

    def rate(count, of):
        return np.log((count + 0.5) / (of + 1.0))

    return [
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        rate(len(set(words)), n), rate(without[SYMBOLS], size), rate(without[DIGITS], size), rate(without[CAPITALS], size), rate(without[SIGNS], size),
        rate(without[STOPS], n), rate(data.count(b"!"), n), rate(data.count(b","), n), rate(len(lines), n), np.log1p(n / max(1, len(lines))),
        rate(len(lines) - len(set(lines)), len(lines)), np.log(len(zlib.compress(data, 1)) / (size + 8.0)),
    ]


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``x``, the statistics, of every row."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["key", "x"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, x array<double>").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors and log determinants; the log odds of the classes."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, with the classes' odds."""
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return density[1] - density[0] + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x) / TEMPERATURE, -700, 700)))


def fit(training: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model | None:
    """The model of rows with ``x`` and ``label`` 0 or 1, from sums over all of them; None if a class is missing."""
    p = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(p)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    found = {r["label"]: r for r in training.filter(F.col("label").isin(0, 1)).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), *sums, *products).collect()}
    if len(found) < 2:
        return None
    n = np.array([found[y]["n"] for y in (0, 1)], dtype=float)
    means = np.array([[found[y][f"s{i}"] for i in range(p)] for y in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, p, p))
    for y in (0, 1):
        for i in range(p):
            for j in range(i, p):
                scatter[y, i, j] = scatter[y, j, i] = found[y][f"p{i}_{j}"] - n[y] * means[y, i] * means[y, j]
    pooled = scatter.sum(axis=0) / max(1.0, n.sum() - 2)
    floor = 1e-4 + 1e-3 * np.diag(pooled)
    factors, log_dets = [], []
    for y in (0, 1):
        own = (1 - to_pooled) * scatter[y] / max(1.0, n[y] - 1) + to_pooled * pooled
        shrunk = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(own)) + np.diag(floor)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(np.log(np.diag(lower)).sum())
    return Model(means, np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def scored(rows: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` and ``predicted`` of the rows of ``measured``."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
            y = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], ["key", "score", "predicted"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), "x").mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def fold(key: str, of: int) -> Column:
    """Remainder of the checksum of a key as text; null keys are in none."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


@query("op2_quality")
def op2_quality(spark, sf_dir):
    rows = written(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = fit(rows.filter(~held_out).join(labels, "doc_id"))
    return scored(rows, model).withColumn("held_out", held_out)
