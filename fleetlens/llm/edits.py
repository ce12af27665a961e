"""Token counts that follow edits without encoding whole texts again.

A document's pre-tokens are cut into segments, the leaves of a tree of token sums. An
edit re-encodes the segments it touches and their neighbours, until the pre-tokens
before and after it fall where they fell, and only sums on the way to the root change.

Defined results: a null text counts as empty; edits that are null, out of order, out of
range or that overlap an earlier one are left out and counted in ``n_skipped``; rows are
treated one by one, so repeated rows give repeated results; columns besides those named
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query
from fleetlens.llm.bytepairs import Encoder, encoder

#: Pre-tokens of a segment when it is made.
SEGMENT = 32
#: Edits with fewer characters between them are one region, encoded once.
NEAR = 64
EDITS = "array<struct<start:int,end:int,text:string>>"


class SegmentTree:
    """Segments of one text with sums of tokens and characters above them.

    A segment ends only where a space stands between another sign and a letter: a
    pre-token starts at such a space whatever else stands on either side.
    """

    BORDER = re.compile(r"(?<=[^\s]) (?=[A-Za-z])")

    def __init__(self, text: str, own: Encoder):
        self.own = own
        self.encoded = 0  # characters given to the encoder so far
        self.texts = self.segments(text)
        self.build()

    def segments(self, text: str) -> list[str]:
        """A text cut at borders, about every ``SEGMENT`` pre-tokens."""
        cuts, step = [0], SEGMENT * 5
        at = step
        while at < len(text):
            m = self.BORDER.search(text, at)
            if not m:
                break
            cuts.append(m.start())
            at = m.start() + step
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.own.encode(text)) // 4

    def build(self) -> None:
        self.leaves = 1 << max(0, (len(self.texts) - 1).bit_length())
        self.tokens, self.chars = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, t in enumerate(self.texts):
            self.tokens[self.leaves + i], self.chars[self.leaves + i] = self.count(t), len(t)
        for node in range(self.leaves - 1, 0, -1):
            self.sum(node)

    def sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds a character, and where the segment starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def put(self, i: int, text: str) -> None:
        """Another text for a segment; sums on the way to the root follow."""
        self.texts[i] = text
        node = self.leaves + i
        self.tokens[node], self.chars[node] = self.count(text) if text else 0, len(text)
        while node > 1:
            node //= 2
            self.sum(node)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in place of the characters from ``start`` up to ``end``."""
        first, at = self.find(start)
        last, at_last = self.find(end) if end > start else (first, at)
        joined = "".join(self.texts[first : last + 1])
        joined = joined[: start - at] + text + joined[end - at :]
        # Borders to the neighbours must hold again; else the neighbour joins in.
        while first > 0 and not self.holds(self.texts[first - 1], joined):
            first -= 1
            joined = self.texts[first] + joined
        while last + 1 < len(self.texts) and not self.holds(joined, self.texts[last + 1]):
            last += 1
            joined += self.texts[last]
        self.put(first, joined)
        for i in range(first + 1, last + 1):
            if self.texts[i]:
                self.put(i, "")

    def holds(self, left: str, right: str) -> bool:
        return bool(left) and bool(self.BORDER.match(left[-1] + right[:2], 1))


def apply_edits(text: str, edits: list, own: Encoder) -> dict:
    """Token counts of a text before and after edits, whose places are those of the text before."""
    tree = SegmentTree(text, own)
    before, built = tree.total, tree.encoded
    regions, reached, skipped = [], 0, 0
    for e in edits:
        if e is None or None in (e["start"], e["end"]) or not reached <= e["start"] <= e["end"] <= len(text):
            skipped += 1
            continue
        if regions and e["start"] - reached < NEAR:
            regions[-1] = (regions[-1][0], e["end"], regions[-1][2] + text[reached : e["start"]] + (e["text"] or ""))
        else:
            regions.append((e["start"], e["end"], e["text"] or ""))
        reached = e["end"]
    shift = 0
    for start, end, new in regions:
        tree.replace(start + shift, end + shift, new)
        shift += len(new) - (end - start)
    return {
        "tokens_before": before, "n_tokens": tree.total, "n_segments": len(tree.texts),
        "chars_encoded": tree.encoded - built, "n_chars_after": tree.chars[1], "n_skipped": skipped,
    }


FIGURES = ("tokens_before", "n_tokens", "n_segments", "chars_encoded", "n_chars_after", "n_skipped")


def count_edited(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts of every row before and after its edits, and how many characters were encoded again.

    ``edits`` is an array of (start, end, text) in ascending order, in code points of
    the text before, end exclusive.
    """

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            done = [apply_edits(t or "", e or [], own) for t, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[f] for d in done], pa.int64()) for f in FIGURES)], ["key", *FIGURES])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(edits).cast(EDITS).alias("edits"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"key {kind}", *(f"{f} long" for f in FIGURES)])).withColumnRenamed("key", key)


def cleaning_edits(text: Column) -> Column:
    """Edits that a cleaning step makes: personal data is masked, repeated lines and runs of signs go."""

    @F.pandas_udf(EDITS)
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _cleaning(t or ""))

    return find(text)


RUNS = re.compile(r"[#*$%&|<>]{2,}")


def _cleaning(text: str) -> list[dict]:
    from fleetlens.llm.pii import base_spans

    found = [(a, b, f"<{kind}>") for a, b, kind in base_spans(text)] + [(m.start(), m.end(), "") for m in RUNS.finditer(text)]
    seen, at = set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            found.append((at, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    out, reached = [], 0
    for a, b, new in sorted(found):
        if a >= reached:
            out.append({"start": a, "end": b, "text": new})
            reached = b
    return out


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edited(documents.withColumn("edits", cleaning_edits(F.col("text"))), public_tokenizers.path("byte_bpe_50k.json"))
