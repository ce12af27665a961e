"""The fill-in-the-middle transformation against a plain version of its contract, and its round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import infill, load_all

SMALL = "/root/testdata/sf0.001"


def plain_version(key, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\nx"), (5, "one line"), (6, "a\nb\n"), (7, "has <P> in it\nand more\n"), (8, "<M>"), (9, "< P>\n<\nS>\n<P"),
    (10, "ends with <S\nand <M\n<"), (11, "é中\U0001f600\r\n" * 3000), (12, "z" * 30_000 + "\n" + "y" * 9000), (13, "a\x00b\x0b\n\x85 c\n"), (None, "no\nkey\nat\nall\n"),
    (5, "one line"), (5, "another\nof one key"), *[(100 + i, f"l{i}\n" * (i % 7) + "end") for i in range(60)],
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in ("key", "row", "place", "body", "form", "section", "output", "n")})


def test_outputs_and_round_trip(odd):
    wanted = sorted((str(k), *map(str, plain_version(k, t))) for k, t in ODD)
    out = infill.transform(odd, size=64)
    assert sorted(tuple(map(str, (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in out.collect()) == wanted
    assert {r[2] for r in wanted} == {"plain", "psm", "spm"}
    back = infill.restore(out, size=100).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(k), t or "") for k, t in ODD)


@pytest.mark.parametrize("size", [3, 64, 4096])
def test_digests_do_not_depend_on_the_size_of_pieces(odd, size):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = sorted((str(k), sha(plain_version(k, t)[4]), sha(t or "")) for k, t in ODD if size > 3 or len(t or "") < 1000)
    rows = infill.digests(infill.pieces(odd if size > 3 else odd.filter("text is null or length(text) < 1000"), size=size)).collect()
    assert sorted((str(r.key), r.output_sha256, r.restored_sha256) for r in rows) == wanted


def test_rate_and_order(odd):
    rows = infill.transform(odd, rate=40, spm=0).collect()
    wanted = sorted(str(plain_version(k, t, 40, 0)[1]) for k, t in ODD)
    assert sorted(r.form for r in rows) == wanted and {"plain", "psm"} == {*wanted}


def test_empty_table(odd):
    assert infill.transform(odd.limit(0)).count() == 0 and infill.restore(infill.transform(odd.limit(0))).count() == 0
    assert infill.digests(infill.pieces(odd.limit(0))).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    df = load_all()["op11_fill_in_middle"][0](spark, SMALL)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = df.collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        *head, output = plain_version(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == head
        assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
