"""Fill-in-the-middle transformation by a secondary sort.

A text is cut into units (lines); two hashed cuts part them into prefix, middle and
suffix. What is emitted are pieces of a bounded size, keyed by their row and their place
in the output. One exchange by row with a sort inside its partitions (the DataFrame form
of repartitionAndSortWithinPartitions) lets a task stream the pieces in output order into
running digests, or into texts. For restoration the pieces of the output are found again
by the sentinels alone and sorted once more inside the same partitions, by their place in
the original; no second exchange is needed, since a row's pieces are together already. No
task holds more than one piece of a text at a time between the two ends.

Defined results: a null or empty text is plain and empty; a text that holds a sentinel is
plain; a null key is hashed as no digits; repeated rows and equal keys are transformed
row by row; a unit longer than a piece is cut between code points; columns besides the key
and the text are ignored; an empty table gives an empty result. The input should be a
stored table, so that a task that is run again reads the same rows in the same order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetlens.llm import query

# The sentinels, the units and the hash's salt.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, MIDDLE, SUFFIX)
UNIT = re.compile(r"[^\n]*\n|[^\n]+")
SEED = 7
#: Percent of texts that are transformed, and of those the ones with the suffix first.
RATE, SPM = 100, 50
#: Code points of a piece at most; bounds the memory of a batch only.
PIECE = 4096

MARK = re.compile(b"(<P>|<M>|<S>)")
#: Place of a sentinel's section in the original.
SECTION = {s.encode(): i for i, s in enumerate(SENTINELS)}
#: Sections of the output in their order, as indexes of (prefix, middle, suffix).
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}


def draws(key, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers that decide over a document."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def sections(key, text: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, tuple[str, str, str] | None]:
    """The number of units, the form, and prefix, middle and suffix of a text that is not plain."""
    ends = [m.end() for m in UNIT.finditer(text)]
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (0, *ends)[first], (0, *ends)[second]
    return n, "spm" if h4 % 100 < spm else "psm", (text[:a], text[a:b], text[b:])


def output_parts(form: str, text: str, cut: tuple[str, str, str] | None, size: int = PIECE) -> Iterator[str]:
    """The output in order, in parts of bounded size; a sentinel begins its section's first part."""
    for start, body in ((SENTINELS[i], cut[i]) for i in ORDER[form]) if cut else (("", text),):
        yield start + body[:size]
        for at in range(size, len(body), size):
            yield body[at : at + size]


HEAD = ("n", "form", "prefix_chars", "middle_chars")


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, size: int = PIECE) -> DataFrame:
    """The output of every row in pieces: ``row`` and ``place``, the piece, and with the first one what is known of the row."""

    def run(batches):
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row += 1
                t = value or ""
                n, form, cut = sections(k, t, seed, rate, spm)
                head = (k, n, form, *((len(cut[0]), len(cut[1])) if cut else (None, None)))
                for place, part in enumerate(output_parts(form, t, cut, size)):
                    out.append((row, place, part.encode(), *(head if place == 0 else (None, None, form, None, None))))
                    held += len(part)
                if held >= 1 << 24:
                    yield _batch(out, arrow)
                    out, held = [], 0
            yield _batch(out, arrow)

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"row long, place long, body binary, key {rows.schema['key'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long"
    arrow = _arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def by_place(rows: DataFrame, *places: str) -> DataFrame:
    """Rows of one document together, in the order of their places."""
    return rows.repartition("row").sortWithinPartitions("row", *places)


def _streamed(batches: Iterable[pa.RecordBatch], schema: pa.Schema, begin: Callable, take: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Feed sorted rows to one document's state at a time; ``take`` and ``end`` may return rows of the result."""
    row, state, out, held = None, None, [], 0
    for batch in batches:
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            if values[0] != row:
                if row is not None:
                    out.extend(end(row, state))
                row, state = values[0], begin()
            for made in take(state, values):
                out.append(made)
                held += len(made[2]) if isinstance(made[2], bytes) else 64
            if held >= 1 << 24:
                yield _batch(out, schema)
                out, held = [], 0
    if row is not None:
        out.extend(end(row, state))
    if out:
        yield _batch(out, schema)


def split_output(form: str, section: int, body: bytes) -> Iterator[tuple[int, bytes]]:
    """Sections of the original that a part of an output holds, given the section in which the part before it ended."""
    if form == "plain":
        yield 0, body
        return
    for part in MARK.split(body):
        if part in SECTION:
            section = SECTION[part]
        yield section, b"" if part in SECTION else part


def digests(parts: DataFrame) -> DataFrame:
    """``key``, what is known of a row, and the digests of its output and of the text restored from it."""
    kind = parts.schema["key"].dataType.simpleString()
    # A row of the first stream is a part of the original, or, with section -1, the digest of the output.
    told_found = f"row long, section int, body binary, place long, key {kind}, n long, form string, prefix_chars long, middle_chars long"
    found = _arrow_schema(told_found)
    told_done = f"row long, key {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    done = _arrow_schema(told_done)

    def forwards(batches):
        def begin():
            return {"sha": hashlib.sha256(), "section": 0, "head": None, "place": 0}

        def take(state, values):
            row, place, body, *head = values
            state["sha"].update(body)
            if place == 0:
                state["head"] = head
            for section, part in split_output(head[2], state["section"], body):
                state["section"] = section
                if part:
                    state["place"] += 1
                    yield (row, section, part, state["place"], None, None, None, None, None)

        def end(row, state):
            return [(row, -1, state["sha"].hexdigest().encode(), 0, *state["head"])]

        return _streamed(batches, found, begin, take, end)

    def backwards(batches):
        def begin():
            return {"sha": hashlib.sha256(), "head": None, "output": None}

        def take(state, values):
            _, section, body, _, *head = values
            if section < 0:
                state["head"], state["output"] = head, body.decode()
            else:
                state["sha"].update(body)
            return ()

        def end(row, state):
            return [(row, *state["head"], state["output"], state["sha"].hexdigest())]

        return _streamed(batches, done, begin, take, end)

    parted = by_place(parts, "place").mapInArrow(forwards, told_found)
    return parted.sortWithinPartitions("row", "section", "place").mapInArrow(backwards, told_done).drop("row")


def _joined(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The parts of each row joined to one text; ``columns`` come with the first part."""
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("row", *columns).schema)
    schema = f"{told}, `{name}` string"
    arrow = _arrow_schema(schema)

    def run(batches):
        def begin():
            return {"head": None, "parts": []}

        def take(state, values):
            _, body, *head = values
            if state["head"] is None:
                state["head"] = head
            state["parts"].append(body)
            return ()

        def end(row, state):
            return [(row, *state["head"], b"".join(state["parts"]).decode())]

        return _streamed(batches, arrow, begin, take, end)

    return rows.select("row", "body", *columns).mapInArrow(run, schema)


def transform(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the whole ``output`` of every row."""
    out = _joined(by_place(pieces(documents, key, text, **options), "place"), ["key", *HEAD], "output")
    return out.drop("row").withColumnRenamed("key", key)


def restore(outputs: DataFrame, key: str = "doc_id", size: int = PIECE) -> DataFrame:
    """``key`` and the original ``text`` of rows with ``output`` and ``form``."""
    rows = outputs.select(F.col(key).alias("key"), "form", "output")
    schema = f"row long, body binary, key {rows.schema['key'].dataType.simpleString()}, section int, place long"
    arrow = _arrow_schema(schema)

    def run(batches):
        row = (TaskContext.get().partitionId() << 40) - 1
        for batch in batches:
            out = []
            for k, form, output in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                out.append((row, b"", k, -1, 0))
                for section, part in split_output(form, 0, (output or "").encode()):
                    out += [(row, part[i : i + size], None, section, i + 1) for i in range(0, len(part), size)]
            yield _batch(out, arrow)

    return _joined(by_place(rows.mapInArrow(run, schema), "section", "place"), ["key"], "text").drop("row").withColumnRenamed("key", key)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, x, 8) AS BIGINT) FOR x IN [1, 9, 17, 25]] AS h FROM t),
n AS (SELECT *, CAST(len(units) AS BIGINT) AS n FROM u),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM n
),
p AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark, sf_dir):
    told = digests(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return told.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
