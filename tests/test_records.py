"""The record source against plain Python, whatever the ranges; and bucket tables through crashes."""

import gzip
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.sources import buckets, records


def by_ranges(data, size, reader):
    """Records of all ranges of a text held in memory."""
    out = []
    for start in range(0, len(data), size):
        stream = pa.BufferReader(data)
        at = max(0, start - 8)
        out += reader(stream, at, start, min(start + size, len(data)))
    return out


def plain_records(data, separator, unless=b""):
    pattern = re.escape(separator) + (b"(?!" + re.escape(unless) + b")" if unless else b"")
    out, at = [], 0
    for m in re.finditer(pattern, data):
        out.append((at, data[at : m.start()]))
        at = m.end()
    return out + ([(at, data[at:])] if at < len(data) else [])


@pytest.mark.parametrize("separator,unless", [(b"\n", b""), (b";\n#", b""), (b";\n#", b" x"), (b"\n20", b"")])
def test_separated_ranges(monkeypatch, separator, unless):
    rnd = random.Random(3)
    for trial in range(150):
        data = b"".join(rnd.choice([b";", b"\n", b"#", b" x", b"20", b"a", separator]) for _ in range(rnd.randrange(60)))
        monkeypatch.setattr(records, "READ", rnd.choice([1, 3, 7, 1000]))

        def read(stream, at, start, end):
            at = max(0, start - len(separator))
            stream.seek(at)
            return list(records.separated(records.Window(stream, at), start, end, separator, unless))

        for size in (1, 2, 5, 100):
            assert by_ranges(data, size, read) == plain_records(data, separator, unless), (data, size)


def test_begun_ranges(monkeypatch):
    rnd = random.Random(4)
    form = re.compile(rb"B\d")
    for trial in range(200):
        lines = [rnd.choice([b"B1 x", b"B2", b"more", b"", b" B3"]) for _ in range(rnd.randrange(8))]
        data = b"\n".join(lines) + rnd.choice([b"", b"\n"])
        wanted, at = [], 0
        for line in data.split(b"\n") if data else []:
            if form.match(line):
                wanted.append((at, [line]))
            elif wanted and at < len(data):
                wanted[-1][1].append(line)
            at += len(line) + 1
        monkeypatch.setattr(records, "READ", rnd.choice([1, 4, 1000]))

        def read(stream, at, start, end):
            at = max(0, start - 1)
            stream.seek(at)
            return list(records.begun(records.Window(stream, at), start, end, form))

        for size in (1, 3, 6, 100):
            assert by_ranges(data, size, read) == [(a, b"\n".join(w)) for a, w in wanted], (data, size)


def test_files_folders_and_patterns(spark, tmp_path):
    for name, text in (("a/1.log", "x\ny\n"), ("a/_SUCCESS", "no"), ("a/.hidden", "no"), ("b/2.log", "z"), ("b/part=3/c.log", "é\n\nlast"), ("empty.log", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b" / "3.log.gz").write_bytes(gzip.compress(b"g1\ng2"))
    (tmp_path / "b" / "bad.log").write_bytes(b"\xff\xfe\nok")
    values = lambda p, **o: sorted((r.file.rsplit("/", 1)[1], r.pos, r.size, r.value) for r in records.read_records(spark, p, **o).collect())
    assert values(str(tmp_path / "a")) == [("1.log", 0, 1, "x"), ("1.log", 2, 1, "y")]
    assert values(f"{tmp_path}/*/[12].log") == [("1.log", 0, 1, "x"), ("1.log", 2, 1, "y"), ("2.log", 0, 1, "z")]
    assert values(f"file://{tmp_path}/b/part=3", range_bytes=2) == [("c.log", 0, 2, "é"), ("c.log", 3, 0, ""), ("c.log", 4, 4, "last")]
    assert values([f"{tmp_path}/b/3.log.gz", f"{tmp_path}/empty.log"]) == [("3.log.gz", 0, 2, "g1"), ("3.log.gz", 3, 2, "g2")]
    assert [v[1:3] for v in values(f"{tmp_path}/b/bad.log")] == [(0, 2), (3, 2)]
    with pytest.raises(Exception, match="overlap"):
        values(str(tmp_path / "a"), separator="aa")
    with pytest.raises(Exception, match="nowhere"):
        values(str(tmp_path / "nowhere"))


def test_small_files_share_tasks(spark, tmp_path):
    wanted = []
    for i in range(300):
        (tmp_path / f"p={i:03d}").mkdir()
        (tmp_path / f"p={i:03d}" / "log").write_bytes(b"" if i % 50 == 7 else b"a%d\n\xff\n" % i if i % 60 == 1 else b"a%d\n\nb" % i)
        values = [] if i % 50 == 7 else [f"a{i}", "\ufffd"] if i % 60 == 1 else [f"a{i}", "", "b"]
        at = [0, 2 + len(str(i)), 3 + len(str(i))]
        wanted += [(f"p={i:03d}", at[k], v) for k, v in enumerate(values)]
    df = records.read_records(spark, f"{tmp_path}/*")
    assert df.rdd.getNumPartitions() <= 5 * spark.sparkContext.defaultParallelism
    assert sorted((r.file.split("/")[-2], r.pos, r.value) for r in df.collect()) == wanted
    begun_here = records.read_records(spark, f"{tmp_path}/*", form="a")
    assert begun_here.count() == 294 and begun_here.filter("pos > 0").count() == 0


def test_ranges_are_dealt_by_cost(tmp_path):
    for name, size in (("1", 10), ("2", 3_000_000), ("3", 10), ("4", 10)):
        (tmp_path / name).write_bytes(b"x" * size)
    reader = records.RecordReader({"path": str(tmp_path), "rangebytes": "1000000"})
    shares = [[(r.file.rsplit("/", 1)[1], r.start) for r in p.ranges] for p in reader.partitions()]
    assert shares == [[("1", 0)], [("2", 0)], [("2", 1_000_000)], [("2", 2_000_000)], [("3", 0), ("4", 0)]]
    assert [list(records.dealt(c, 5)) for c in ([], [9], [2, 3, 1], [5, 5])] == [[], [(0, 1)], [(0, 2), (2, 3)], [(0, 1), (1, 2)]]
    (tmp_path / "none").mkdir()
    assert [p.ranges for p in records.RecordReader({"path": str(tmp_path / "none")}).partitions()] == [[]]


def test_written_records(spark, tmp_path):
    rows = [(p, o, None if o == 3 else f"é{p}.{o}") for o in range(5) for p in [*range(-1, 40), None]]
    df = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "p long, o int, v string").repartition(7)
    folder = f"file://{tmp_path}/out"
    for again in (False, True):
        records.write_records(df, folder, "p", ["o"], "v", ";\n")
        assert len(list((tmp_path / "out").iterdir())) == 42
        for p in [*range(-1, 40), None]:
            name = "__HIVE_DEFAULT_PARTITION__" if p is None else p
            text = "".join(("" if o == 3 else f"é{p}.{o}") + ";\n" for o in range(5))
            inside = tmp_path / "out" / f"p={name}"
            assert [f.name for f in inside.iterdir()] == ["records"] and (inside / "records").read_text() == text
    assert records.read_records(spark, f"{folder}/*", ";\n").count() == len(rows)
    # An input without rows leaves a folder without logs, and a task that was lost leaves a hidden file at most.
    records.write_records(df.filter("p > 99"), f"{tmp_path}/empty", "p", ["o"], "v")
    assert records.read_records(spark, f"{tmp_path}/empty/*").count() == 0
    (tmp_path / "out" / "p=1" / ".lost").write_text("half")
    assert records.read_records(spark, f"{folder}/*", ";\n").count() == len(rows)
    with pytest.raises(Exception, match="folder"):
        records.write_records(spark.createDataFrame([("../x", 1, "v")], "p string, o int, v string"), folder, "p", ["o"], "v")


def rows_of(table):
    return sorted((r.k, r.v) for r in table.read().collect())


def test_bucket_table(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ["k"], 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    df = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.replace(df([(i, "old") for i in range(40)]))
    old = {r["bucket"]: r["version"] for r in table.manifest()}
    newer = lambda have, seen: have.join(seen.select("k"), "k", "left_anti").unionByName(seen)
    table.merge(df([(3, "new"), (100, "new")]), "b1", newer)
    wanted = sorted([(i, "new" if i == 3 else "old") for i in range(40)] + [(100, "new")])
    assert rows_of(table) == wanted
    touched = {r["bucket"] for r in table.manifest() if r["version"] != old[r["bucket"]]}
    assert touched == {r[0] for r in df([(3, ""), (100, "")]).select(table.bucket(8)).collect()}
    table.merge(df([(3, "again")]), "b1", newer)
    assert rows_of(table) == wanted

    # A crash after the rows are written and before the manifest is: the old version stays, and the change can be made anew.
    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets.BucketTable, "_publish", crash)
        for change in (lambda: table.merge(df([(5, "half")]), "b2", newer), lambda: table.replace(df([(1, "half")]))):
            with pytest.raises(RuntimeError):
                change()
            assert rows_of(table) == wanted
    table.merge(df([(5, "whole")]), "b2", newer)
    assert (5, "whole") in rows_of(table) and len(rows_of(table)) == 41
    table.replace(table.read().filter("k < 0"))
    assert rows_of(table) == []


def test_bucket_table_with_null_keys(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.replace(spark.createDataFrame([(None, "a"), (1, None)], "k long, v string"))
    table.merge(spark.createDataFrame([(2, "b")], "k long, v string"), "x", lambda old, new: old.unionByName(new))
    assert sorted(map(str, table.read().select(F.struct("k", "v")).collect())) == sorted(map(str, spark.createDataFrame([(None, "a"), (1, None), (2, "b")], "k long, v string").select(F.struct("k", "v")).collect()))
