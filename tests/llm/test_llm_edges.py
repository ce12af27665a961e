"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import edits, exact, language, lm, near, packing, pieces, pii, quality, rules

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PROSE = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood again. "
CLASH = ["key", "text_key", "row", "whole", "names", "chunk", "group", "stays", "as", "told", "digest", "score", "n", "word", "count", "_key", "words", "x"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


@pytest.fixture(scope="module")
def odd(spark):
    long = PROSE * 3000
    return table(spark, [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (None, "one", "en", "a", 3),
        (5, PROSE * 5, "en", "a", 1), (5, PROSE * 5, "en", "a", 1), (6, PROSE * 5, "en", "b", 1), (7, long, None, "b", 1), (8, "1234 !!", None, None, 7),
        (9, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 4, "de", "a", 1), (10, "mail a.b@c.org or +1 (988) 555-2485 now", "en", "a", 1),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_pii(odd, none):
    rows = pii.find(odd).collect()
    assert len(rows) == 12 and sum(len(r.base) for r in rows) == 2
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == 12
    assert [r.text for r in clean.filter("doc_id = 10").collect()] == ["mail <EMAIL> or <PHONE> now"]
    assert clean.filter("doc_id = 1 and text is null").count() == 1
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_quality(odd, none):
    rows = quality.measured(odd)
    assert quality.fit(rows.withColumn("label", F.lit(1))) is None
    assert {r.score for r in quality.scored(rows, None).collect()} == {0.5}
    model = quality.fit(rows.withColumn("label", (F.col("doc_id") > 5).cast("int")))
    scores = [r.score for r in quality.scored(rows, model).collect()]
    assert len(scores) == 12 and all(0 <= s <= 1 for s in scores)
    assert quality.scored(quality.measured(none), model).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd, TOKENIZER, length=64).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert sum(r.start == 0 for r in rows) == 12
    assert packing.pack(none, TOKENIZER).count() == 0


def test_near(odd, none):
    rows = near.classes(odd).collect()
    found = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in rows)
    assert found == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (0, 4, 1), (5, 5, 3), (5, 5, 3), (6, 5, 3), (7, 5, 3), (8, 8, 0), (9, 9, 0), (10, 10, 0)])
    kept = near.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 5, 8, 9, 10]
    assert near.classes(none).count() == 0 and near.deduplicate(none).count() == 0


def test_near_copies_that_share_an_id_or_have_none(spark):
    words = PROSE.split()
    near_copy = " ".join([*words, "and", "more", "of", "it"])
    rows = [(7, PROSE + "and more of it", None, None, 1), (7, near_copy + " all", None, None, 1), (None, PROSE * 2, None, None, 1), (None, (PROSE * 2).replace("fox", "vixen", 1), None, None, 1), (9, "quite another text than all of these here", None, None, 1)]
    rows[3] = (None, PROSE * 2 + "again now", None, None, 1)
    df = table(spark, rows)
    found = near.classes(df).collect()
    groups = {(r.class_id, r.class_hash) for r in found}
    assert len(near.deduplicate(df).collect()) == len(groups) < len(rows)


def test_lm(odd, none):
    model = lm.train(odd, odd.filter("source = 'a'"), size=64)
    rows = {(r.doc_id, r.n_tokens): r.score for r in lm.score(odd, model).collect()}
    assert rows[1, 0] == rows[2, 0] == rows[3, 0] == 0.0 and len(rows) == 11
    empty = lm.train(none, none, size=64)
    assert lm.score(none, empty).count() == 0


def test_exact(odd, none):
    rows = exact.groups(odd, block=16).collect()
    found = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)
    assert found == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 2, True), (0, 4, 2, False), (5, 5, 3, True), (5, 5, 3, False), (6, 5, 3, False), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)])
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7, 8, 9, 10]
    assert exact.groups(none).count() == 0 and exact.deduplicate(none).count() == 0


def test_language(odd, none):
    content = language.dictionaries(odd)
    assert set(content) == {"en", "de"} and list(content)[0] == "en"
    rows = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, content).collect()]
    assert {i for i, lang, _ in rows if lang == "und"} == {1, 2, 3, 8}
    assert all(s == 0 for _, lang, s in rows if lang == "und")
    assert language.keep_identified(odd, content).columns == odd.columns
    assert language.dictionaries(none) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(none, content).count() == 0


def test_pieces(odd, none):
    rows = pieces.decode(pieces.encode(odd, MODEL), MODEL).collect()
    assert len(rows) == 12 and all(r.decoded == "" and r.ids == [] for r in rows if r.doc_id in (1, 2))
    assert pieces.encode(none, MODEL).count() == 0


def test_rules(odd, none):
    rows = rules.judge(odd).collect()
    assert len(rows) == 12 and {r.kept for r in rows if r.doc_id in (1, 2, 3, 4)} == {False}
    assert rules.judge(none).count() == 0


def test_edits(odd, none):
    some = odd.withColumn("edits", F.expr("array(named_struct('start', 0, 'end', 1, 'text', 'x'), null, named_struct('start', 0, 'end', 1, 'text', 'y'), named_struct('start', 5, 'end', 999999999, 'text', ''))"))
    rows = edits.count_edited(some, TOKENIZER).collect()
    assert len(rows) == 12 and all(r.n_skipped == (4 if r.doc_id in (1, 2) else 3) for r in rows)
    assert edits.count_edited(odd.withColumn("edits", F.lit(None)), TOKENIZER).filter("tokens_before <> n_tokens").count() == 0
    assert edits.count_edited(some.limit(0), TOKENIZER).count() == 0


def test_language_with_few_texts_beside_many_copies(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, "one text of which there are many copies", "xx", "a", 1) for i in range(20_000)]
    rows += [(30_000 + i, f"{w} marks a text of its own", "xx", "a", 1) for i, w in enumerate(words)]
    content = language.dictionaries(table(spark, rows))["xx"].decode().split()
    assert len({*content} & {*words}) >= language.DICTIONARY // language.SNIPPET - 1


def test_repeated_rows_are_packed_in_groups_of_bounded_size(spark):
    rows = packing.pack(table(spark, [(None, "", "en", "a", 0)] * 2000), TOKENIZER, group=100).collect()
    groups = [r.sequence_id >> 32 for r in rows]
    assert len(rows) == 2000 and max(map(groups.count, {*groups})) < 200


def test_rules_learn_from_all_documents(odd, monkeypatch):
    seen, learn = [], rules.vote_rates
    monkeypatch.setattr(rules, "vote_rates", lambda patterns, *a, **b: seen.extend(patterns) or learn(patterns, *a, **b))
    judged = rules.judge(odd)
    assert sum(n for _, n in seen) == judged.count() and judged.filter("base_failed").count() > 0
