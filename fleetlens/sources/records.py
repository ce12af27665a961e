"""Text records with their byte position in the file, from a data source that plans byte ranges.

A record belongs to the range in which it begins, so every task finds the positions of
its records by itself and nothing is shuffled for them. Records are what stands between
separators, or, for logs whose entries span lines, what begins with a line of a form.
Small files share a task, for reading and for writing.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, of one read, and of a batch that is handed on; these bound memory, not records.
RANGE, READ, BATCH = 128 << 20, 1 << 20, 4 << 20
#: Records of a batch at most.
BATCH_RECORDS = 8192
#: Bytes that opening a file counts as where ranges are dealt to tasks.
OPENING = 256 << 10
#: Shares of a core where that makes them smaller than a range, so that cores end at about the same time.
SHARES = 4
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
SCHEMA = "file string, pos long, size long, value string"


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int  # -1: to the end, for files that can only be read from their start

    def __post_init__(self):
        super().__init__((self.file, self.start, self.end))


@dataclass
class Ranges(InputPartition):
    """What one task reads, in this order."""

    ranges: list[Range]

    def __post_init__(self):
        super().__init__(None)


def dealt(costs: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose costs add up to ``most`` at most, or one alone, as first and end."""
    first, held = 0, 0
    for i, cost in enumerate(costs):
        if i > first and held + cost > most:
            yield first, i
            first, held = i, 0
        held += cost
    if first < len(costs):
        yield first, len(costs)


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or URI, the path there, and what goes before it."""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def listed(path: str) -> Iterator[tuple[str, int]]:
    """Files under a path with their sizes: a file, a folder, or a pattern; hidden names are left out, in order of names."""
    parts = path.split("/")
    fixed = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    system, root, before = opened("/".join(parts[:fixed]) or "/")
    pattern = parts[fixed:]

    def hidden(name: str) -> bool:
        return name.startswith(("_", "."))

    def below(folder: str, left: list[str]) -> Iterator[tuple[str, int]]:
        inside = system.get_file_info(pafs.FileSelector(folder))
        for info in sorted(inside, key=lambda i: i.path):
            if hidden(info.base_name) or left and not fnmatch.fnmatchcase(info.base_name, left[0]):
                continue
            if info.type == pafs.FileType.Directory:
                yield from below(info.path, left[1:])
            elif len(left) <= 1:
                yield before + info.path, info.size

    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        yield before + root, info.size
    else:
        yield from below(posixpath.normpath(root), pattern)


class Window:
    """A growing window on a file: what was read and is not yet passed."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.data, self.ended = stream, at, b"", False

    def more(self) -> bool:
        """Read on; False at the end of the file."""
        got = b"" if self.ended else self.stream.read(READ)
        self.ended = not got
        self.data += got
        return bool(got)

    def passed(self, pos: int) -> None:
        """What is before ``pos`` is needed no more; it goes once it is as much as a read."""
        if pos - self.at >= READ:
            self.data, self.at = self.data[pos - self.at :], pos

    def cut(self, pos: int, end: int | None = None) -> bytes:
        return self.data[pos - self.at : None if end is None else end - self.at]

    def find(self, what: bytes, pos: int, unless: bytes = b"") -> int:
        """Where ``what`` stands from ``pos`` on and ``unless`` does not follow, or -1."""
        while True:
            i = self.data.find(what, pos - self.at)
            if i < 0:
                pos = max(pos, self.at + len(self.data) - len(what) + 1)
                if not self.more():
                    return -1
                continue
            after = i + len(what)
            if unless:
                while len(self.data) < after + len(unless) and self.more():
                    pass
                if self.data.startswith(unless, after):
                    pos = self.at + after
                    continue
            return self.at + i


def separated(window: Window, start: int, end: int, separator: bytes, unless: bytes = b"") -> Iterator[tuple[int, bytes]]:
    """Records that begin in a range, between separators; what follows the last one counts if it is not empty."""
    pos = start
    if start:
        cut = window.find(separator, window.at, unless)
        if cut < 0:
            return
        pos = cut + len(separator)
    while end < 0 or pos < end:
        window.passed(pos)
        cut = window.find(separator, pos, unless)
        if cut < 0:
            if rest := window.cut(pos):
                yield pos, rest
            return
        yield pos, window.cut(pos, cut)
        pos = cut + len(separator)


def begun(window: Window, start: int, end: int, form: re.Pattern) -> Iterator[tuple[int, bytes]]:
    """Records that begin in a range with a line of the form, up to the next such line; the last line's end is not part of them."""
    pos, first, lines = start, -1, []
    if start:
        cut = window.find(b"\n", window.at)
        if cut < 0:
            return
        pos = cut + 1
    while True:
        window.passed(pos)
        cut = window.find(b"\n", pos)
        line = window.cut(pos, None if cut < 0 else cut)
        if cut < 0 and not line:
            break
        if form.match(line):
            if first >= 0:
                yield first, b"\n".join(lines)
            first, lines = (pos, [line]) if end < 0 or pos < end else (-1, [])
        elif first >= 0:
            lines.append(line)
        if cut < 0 or first < 0 and 0 <= end <= cut + 1:
            break
        pos = cut + 1
    if first >= 0:
        yield first, b"\n".join(lines)


class RecordReader(DataSourceReader):
    """Plans ranges of files and reads the records that begin in one."""

    def __init__(self, options):
        self.paths = options["path"].split("\n")
        self.range = int(options.get("rangebytes", RANGE))
        self.tasks = max(1, int(options.get("tasks", 1)))
        self.separator = options.get("separator", "\n").encode()
        self.unless = options.get("unless", "").encode()
        form = options.get("form")
        self.form = re.compile(form.encode()) if form else None
        if any(self.separator.startswith(self.separator[i:]) for i in range(1, len(self.separator))):
            raise ValueError("a separator must not overlap itself: where it stands would depend on where reading began")

    def partitions(self) -> list[Ranges]:
        ranges, costs = [], []
        for path in self.paths:
            for file, size in listed(path):
                if file.endswith(COMPRESSED):
                    found = [Range(file, 0, -1)]
                else:
                    found = [Range(file, at, min(at + self.range, size)) for at in range(0, size, self.range)]
                ranges += found
                costs += [OPENING + (size if r.end < 0 else r.end - r.start) for r in found]
        most = min(self.range, max(OPENING, sum(costs) // (SHARES * self.tasks)))
        return [Ranges(ranges[i:j]) for i, j in dealt(costs, most)] or [Ranges([])]

    def records(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """Position and bytes of the records that begin in one range."""
        system, inner, _ = opened(part.file)
        before = 1 if self.form else len(self.separator)
        if part.end < 0:
            stream, at = system.open_input_stream(inner), 0
        else:
            stream, at = system.open_input_file(inner), max(0, part.start - before)
            stream.seek(at)
        with stream:
            window = Window(stream, at)
            if self.form:
                yield from begun(window, part.start, part.end, self.form)
            else:
                yield from separated(window, part.start, part.end, self.separator, self.unless)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, places, values, held = [], [], [], 0
        for part in partition.ranges:
            for pos, value in self.records(part):
                files.append(part.file)
                places.append(pos)
                values.append(value)
                held += len(value)
                if held >= BATCH or len(values) >= BATCH_RECORDS:
                    yield self.batch(files, places, values)
                    files, places, values, held = [], [], [], 0
        if values:
            yield self.batch(files, places, values)

    @staticmethod
    def batch(files: list[str], places: list[int], values: list[bytes]) -> pa.RecordBatch:
        sizes = pa.array(map(len, values), pa.int64())
        try:
            text = pa.array(values, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), sizes, text], ["file", "pos", "size", "value"])


class RecordWriter(DataSourceArrowWriter):
    """Writes rows ``(folder, text)`` that come folder by folder: one file in each, which is there whole or not at all."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root, _ = opened(self.path)
        name, stream, hidden = None, None, f".{uuid.uuid4().hex}"

        def close() -> None:
            # A task that runs again puts the same records in the place of what an earlier one left.
            if stream is not None:
                stream.close()
                system.move(f"{root}/{name}/{hidden}", f"{root}/{name}/records")

        for batch in iterator:
            texts, runs, i = batch.column(1).cast(pa.large_binary()), pc.run_end_encode(batch.column(0)), 0
            for folder, j in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if folder != name:
                    close()
                    if not re.fullmatch(r"[\w=.+-]+", folder):
                        raise ValueError(f"{folder!r} can't name a folder")
                    system.create_dir(f"{root}/{folder}")
                    name, stream = folder, system.open_output_stream(f"{root}/{folder}/{hidden}")
                stream.write(whole(texts[i:j]))
                i = j
        close()
        return WriterCommitMessage()


def whole(texts: pa.LargeBinaryArray) -> memoryview:
    """The bytes of all texts in a row, which lie so in memory."""
    _, offsets, data = texts.buffers()
    place = memoryview(offsets).cast("q")
    return memoryview(data)[place[texts.offset] : place[texts.offset + len(texts)]] if data else memoryview(b"")


class RecordSource(DataSource):
    """``spark.read.format("records")``: options ``path``, ``separator`` and ``unless``, or ``form``, ``rangeBytes`` and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite) -> RecordWriter:
        return RecordWriter(self.options)


def read_records(spark: SparkSession, path: str | list[str], separator: str = "\n", unless: str = "", form: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``(file, pos, size, value)`` of text files: records between separators, or begun by a line of a form.

    A separator that ``unless`` follows is none. ``pos`` and ``size`` are bytes of the file
    (of the text, in a compressed one), whatever the ranges; bytes that are no UTF-8 are
    replaced in ``value`` only. Compressed files are one range each, and ranges of small files
    share a task.
    """
    spark.dataSource.register(RecordSource)
    options = {"path": path if isinstance(path, str) else "\n".join(path), "separator": separator, "unless": unless, "rangeBytes": str(range_bytes), "tasks": str(spark.sparkContext.defaultParallelism)}
    return spark.read.format("records").options(**options, **({"form": form} if form else {})).load()


def write_records(rows: DataFrame, path: str, part: str, order: list[str], value: str, separator: str = "\n") -> None:
    """One text file ``<part>=.../records`` for each value of ``part``: ``value`` in order, each followed by the separator.

    A file is written by one task, many small ones by the same; this takes no file commit per part.
    """
    rows.sparkSession.dataSource.register(RecordSource)
    system, root, _ = opened(path)
    system.create_dir(root)
    name = F.coalesce(F.nullif(F.col(part).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    x = rows.repartition(part).sortWithinPartitions(part, *order)
    x = x.select(F.concat(F.lit(f"{part}="), name).alias("folder"), F.concat(F.coalesce(value, F.lit("")), F.lit(separator)).alias("text"))
    x.write.format("records").mode("append").save(path)


def present(col: Column) -> Column:
    """NULL for empty text."""
    return F.when(col != "", col)
