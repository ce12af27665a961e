"""Column masking and seeded synthetic tables.

Every choice is a hash of the row key, the column and the seed, so a result
does not depend on partitioning, retries or the number of executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import ordered

# --- Fixed values: the patterns of the built-in column types. The capture groups --
# --- say which parts are replaced; the first pattern that matches is used. ---------
PATTERNS = {
    "name": [r"(\w+) (\w+)"],
    "phonenumber": [
        r"\d{3}-(\d{3}-\d{4})", r"\(\d{3}\) (\d{3}-\d{4})",
        r"\+?\d{1,3} \d{3} (\d{3} \d{4})", r"\+?\d{1,3} \d{3} (\d{3}-\d{4})",
    ],
    "email": [r"(.*?)@.*"],
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
# -------------------------------------------------------------------------------------


@dataclass
class MaskSpec:
    """How to mask one column.

    ``seeds`` are rows of replacement parts; without them parts are random text.
    ``method`` is ``random`` or ``roundrobin``. ``routine`` names a registered
    function taking the column instead of patterns.
    """

    patterns: list[str] = field(default_factory=list)
    seeds: list[tuple[str, ...]] | None = None
    method: str = "random"
    fail_unmatched: bool = False
    routine: str | None = None


def hash_text(length: Column, *keys: Column, alphabet: str = ALPHABET) -> Column:
    """Text of a given length whose letters are hashes of the keys and the place."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    n = length.cast("int")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(
        F.transform(places, lambda i: F.element_at(letters, (F.pmod(F.xxhash64(*keys, i), F.lit(len(alphabet))) + 1).cast("int"))), ""
    )


def _groups(pattern: str) -> int:
    """Number of capture groups, escapes and ``(?`` left out."""
    plain = pattern.replace(r"\(", "").replace("(?", "")
    return plain.count("(")


def _replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when((at > 0) & (old != ""), F.overlay(text, new, at, F.length(old))).otherwise(text)


def mask_column(column: str, spec: MaskSpec, key: list[str], seed: int = 0, rank: Column | None = None) -> Column:
    """The masked column. NULL counts as an empty text, as unmatched text it passes or fails."""
    text = F.coalesce(F.col(column), F.lit(""))
    if spec.routine:
        return F.call_function(spec.routine, text)
    keys = [*[F.col(k) for k in key], F.lit(column), F.lit(seed)]
    if spec.seeds:
        rows = F.array(*[F.array(*[F.lit(p) for p in row]) for row in spec.seeds])
        pick = F.pmod(rank if spec.method == "roundrobin" and rank is not None else F.xxhash64(*keys), F.lit(len(spec.seeds)))
        chosen = F.element_at(rows, (pick + 1).cast("int"))
        part = lambda i: F.get(chosen, F.lit(i))
    else:
        size = F.greatest(F.pmod(F.xxhash64(*keys, F.lit("n")), F.greatest(F.length(text), F.lit(1))), F.lit(1))
        part = lambda i: hash_text(size, *keys, F.lit(i))
    unmatched = F.raise_error(F.concat(F.lit(f"unable to match {column}: "), text)).cast("string") if spec.fail_unmatched else F.col(column)
    out = unmatched
    for pattern in reversed(spec.patterns):
        whole = rf"\A(?:{pattern})\z"
        masked = text
        for i in range(_groups(pattern)):
            old = F.regexp_extract(text, whole, i + 1)
            masked = _replace_first(masked, old, F.coalesce(part(i), F.lit("")))
        out = F.when(text.rlike(whole), masked).otherwise(out)
    return out


def mask(df: DataFrame, specs: dict[str, MaskSpec], key: list[str], seed: int = 0, rank: Column | None = None) -> DataFrame:
    """Mask several columns in one projection; round robin counts by ``rank`` (a row number column)."""
    return df.withColumns({c: mask_column(c, s, key, seed, rank) for c, s in specs.items()})


def mask_unique(df: DataFrame, column: str, key: list[str], seed: int = 0, length: int = 12) -> DataFrame:
    """Text of ``length`` letters that no other row has, or of as many as it takes to give each row its own.

    Rows are numbered by the hash of their key, block by block; a number is
    scattered by a multiplier without a common factor with the number of texts
    and written in letters. Every row of a table follows this one rule.
    """
    base, places, n = len(ALPHABET), min(length, 10), df.count()
    while base**places < n:
        places += 1
    texts, length = base**places, max(length, places)
    x = df.withColumns({"_at": F.xxhash64(*key, F.lit(seed)), "_one": F.lit(1).cast("long")})
    x = ordered.running_sum(x, {"_row": F.col("_one")}, ["_at", *key], F.shiftright("_at", 44), include_current=False)
    factor, offset = _scatter(texts, seed)
    whole = "decimal(19,0)"
    scattered = F.pmod(F.col("_row").cast(whole) * F.lit(factor).cast(whole) + F.lit(offset).cast(whole), F.lit(texts).cast(whole)).cast("long")
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    unique = F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.element_at(letters, (F.pmod(F.floor(F.col("_n") / F.element_at(F.array(*[F.lit(base**k) for k in range(places)]), i + 1)), F.lit(base)) + 1).cast("int"))), "")
    rest = hash_text(F.lit(length - places), *[F.col(k) for k in key], F.lit(column), F.lit(seed)) if length > places else F.lit("")
    return x.withColumn("_n", scattered).withColumn(column, F.concat(unique, rest)).select(*df.columns)


def _scatter(texts: int, seed: int) -> tuple[int, int]:
    """A multiplier without a common factor with ``texts``, and an offset."""
    factor = ((seed * 2_654_435_761 + texts // 3 + 40_503) % texts) | 1
    while math.gcd(factor, texts) > 1:
        factor += 2
    return factor, (seed * 97 + 12_345) % texts


# --- synthetic tables -----------------------------------------------------------------


def _spread(low: int, high: int, *keys: Column) -> Column:
    return F.lit(low) + F.pmod(F.xxhash64(*keys), F.lit(high - low + 1))


def synthetic_table(ids: DataFrame, spec: dict[str, tuple], seed: int, id_col: str = "id", block: Column | None = None) -> DataFrame:
    """Columns of a seeded table for each id.

    Types: ``("int_pk",)``, ``("integer", n)``, ``("varchar", n)``,
    ``("timestamp",)``, ``("words", n)``, ``("linear_integer", step)``,
    ``("linear_timestamp", step)``. The linear types are running sums of hashed
    steps, taken block by block.
    """
    out, sums = {}, {}
    for name, (kind, *args) in spec.items():
        keys = [F.col(id_col), F.lit(name), F.lit(seed)]
        if kind == "int_pk":
            out[name] = F.col(id_col) + 1
        elif kind == "integer":
            out[name] = _spread(0, args[0] if args else 2**31 - 1, *keys)
        elif kind == "varchar":
            out[name] = hash_text(_spread(1, args[0], *keys, F.lit("n")), *keys)
        elif kind == "timestamp":
            out[name] = F.timestamp_seconds(_spread(0, 1_300_000_000, *keys))
        elif kind == "words":
            count = _spread(1, args[0], *keys, F.lit("n")).cast("int")
            out[name] = F.array_join(
                F.transform(F.sequence(F.lit(1), count), lambda i: hash_text(_spread(1, 10, *keys, i), *keys, i)), " "
            )
        elif kind in ("linear_integer", "linear_timestamp"):
            sums[name] = _spread(0, args[0] if args else 10, *keys)
        else:
            raise ValueError(f"unknown column type {kind!r}")
    df = ids.select(id_col, *[c.alias(n) for n, c in out.items()])
    if sums:
        size = block if block is not None else ordered.id_block(id_col)
        df = ordered.running_sum(df, sums, [id_col], size)
        for name, (kind, *_) in spec.items():
            if kind == "linear_timestamp":
                df = df.withColumn(name, F.timestamp_seconds(name))
    return df.select(id_col, *spec)
