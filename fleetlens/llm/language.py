"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of training text. A text is
cut into blocks, each block is compressed with every dictionary, and the language with
the fewest bytes in all is chosen; narrow margins are rejected.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to
the language with more training text; a corpus without training text makes every text
``und``; rows are judged one by one, so repeated rows give repeated results; columns
besides the key and the text are ignored by ``identify`` and passed on by
``keep_identified``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm import query

#: Bytes of a dictionary, and of the piece of one document in it: the bound of the training sample, per language.
DICTIONARY, SNIPPET = 65_536, 1024
#: Languages at most: dictionaries of the most frequent ones go to every task, 16 MB in all.
LANGUAGES = 256
#: Bytes compressed at once; blocks keep a long text from becoming its own dictionary.
BLOCK = 2048
#: The share by which the runner-up must be larger, else the text is rejected.
MARGIN = 0.002
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """The words of a text in lower case: signs, digits and line ends tell no language."""
    return NO_LETTERS.sub(" ", text.lower()).encode()


def dictionaries(training: DataFrame, text: str = "text", lang: str = "lang", size: int = DICTIONARY, snippet: int = SNIPPET) -> dict[str, bytes]:
    """Raw content for each language, the most frequent first: pieces of training texts, texts and places chosen by hash.

    Only ``size / snippet`` snippets of a language reach the driver. Each comes from a
    different text; copies count once.
    """
    rows = training.filter(F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("at"), F.col(text).alias("text")
    )
    # Passages that texts of several languages begin with would make their dictionaries alike.
    start = F.pmod(F.shiftright("at", 7), F.greatest(F.length("text") - snippet, F.lit(0)) + 1) + 1
    rows = rows.select("lang", "at", F.substr(F.col("text"), start.cast("int"), F.lit(snippet)).alias("snippet"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("at", 0.02).alias("texts")).orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    wanted = size // snippet
    # Texts whose hash falls in the lowest part, four times as many different ones as are wanted.
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 4 * wanted / max(1, r["texts"]))).otherwise(share)
    low = rows.filter((F.col("at") / F.lit(2.0**64) + 0.5) < share).dropDuplicates(["lang", "at"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    chosen = low.withColumn("nth", nth).filter(F.col("nth") <= wanted).select("lang", "at", "snippet").collect()
    out: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["at"])):
        out.setdefault(r["lang"], []).append(folded(r["snippet"]))
    return {r["lang"]: b" ".join(out[r["lang"]])[-size:] for r in counts if r["lang"] in out}


@lru_cache(maxsize=2)
def _compressors(content: tuple[tuple[str, bytes], ...]):
    import zstandard

    # Short matches count, as most words of a text are not in a dictionary as a whole.
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, window_log=18, hash_log=16, chain_log=16, write_content_size=False)
    out = []
    for name, data in content:
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=how)
        out.append((name, zstandard.ZstdCompressor(dict_data=raw, compression_params=how).compress))
    return out


def sizes(text: str, content: tuple[tuple[str, bytes], ...], block: int = BLOCK) -> list[int]:
    """Compressed bytes of a text by language."""
    data = folded(text)
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    return [sum(len(compress(b)) for b in blocks) for _, compress in _compressors(content)]


def classify(text: str | None, content: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score and margin of one text; the score is 1 - 1 / (1 + 50 * margin)."""
    if not text or not content or not LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    found = sizes(text, content)
    best = min(range(len(found)), key=found.__getitem__)
    others = [x for i, x in enumerate(found) if i != best]
    margin = min(others) / found[best] - 1 if others else 1.0
    return content[best][0], 1 - 1 / (1 + 50 * margin), margin


def identify(documents: DataFrame, content: dict[str, bytes], key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``margin`` and ``accepted`` of every row."""
    held = tuple(content.items())

    def run(batches):
        for batch in batches:
            done = [classify(t, held) for t in batch.column(1).to_pylist()]
            cols = list(zip(*done)) if done else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["key", "lang_pred", "score", "margin"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, margin double")
    return found.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= margin)).withColumnRenamed("key", key)


def keep_identified(documents: DataFrame, content: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is told with a wide enough margin."""
    held = tuple(content.items())

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        done = [classify(t, held) for t in texts]
        return pd.Series([lang != UNKNOWN and m >= margin for lang, _, m in done], dtype=bool)

    return documents.filter(accepted(F.col(text)))


def training_rows(documents: DataFrame) -> DataFrame:
    """The rows to learn from: three quarters by checksum of the key."""
    return documents.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(True)))


@query("op7_language")
def op7_language(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identify(documents, dictionaries(training_rows(documents))).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
