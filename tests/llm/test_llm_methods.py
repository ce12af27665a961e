"""Each operator against the library it stands for, brute force or held-out data."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import bytepairs, edits, exact, language, lm, load_all, near, packing, pieces, pii, rules
from fleetlens.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = "ab cT  .,²ms'tllre_-▁é\n\t\x00\x1c\x85\xa0 中\U0001f600<|endoftext|>0123 x²½ɐʰ́"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def random_texts(n, signs=ODD, seed=1, longest=16):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def test_byte_pairs_equal_the_library(library, texts):
    own = bytepairs.Encoder(TOKENIZER)
    for t in [*random_texts(3000), *list(texts.values())[:40]]:
        assert np.frombuffer(own.encode(t), "i4").tolist() == library(t) and "".join(own.split(t)) == t


def test_special_tokens_equal_the_library():
    from tokenizers import Tokenizer

    own, theirs = bytepairs.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for t in ["<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext|", *random_texts(500, longest=30)]:
        t = t.replace("o", "<|endoftext|>") if len(t) % 3 == 0 else t
        assert np.frombuffer(own.encode_marked(t), "i4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_pieces_equal_the_library(texts):
    import sentencepiece

    theirs, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Codec(MODEL)
    for t in [*random_texts(3000), *list(texts.values())[:40]]:
        ids = np.frombuffer(own.encode_batch([t])[0], "i4").tolist()
        assert ids == theirs.encode(t) and own.decode(ids) == theirs.decode(ids)
    with pytest.raises(ValueError):
        own.check({" the": [5]})


def test_pieces_query(spark, texts):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in load_all()["op8_sentence_pieces"][0](spark, SMALL).collect():
        ids = theirs.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()


def check_packing(rows, texts, library, length=1024):
    sequences, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    padding = total = 0
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
        total, padding = total + at, padding + (length - at if at & (at - 1) else 0)
    assert set(by_doc) == set(texts)
    for key, parts in by_doc.items():
        ids, at = [*library(texts[key]), 0], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return padding / total


def test_packing(spark, texts, library):
    assert check_packing(load_all()["op3_packing"][0](spark, SMALL).collect(), texts, library) < 0.02


def test_first_fit_is_first_fit():
    rnd = random.Random(2)
    sizes = [rnd.randrange(1, 65) for _ in range(500)]
    bins, tree = [], packing.FirstFit(64, len(sizes))
    for s in sizes:
        at = next((i for i, room in enumerate(bins) if room >= s), len(bins))
        if at == len(bins):
            bins.append(64)
        assert tree.place(s) == (at, bins[at])
        bins[at] -= s


def similar(texts):
    """Links of each document and the least id of its group, from inverted lists."""
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    count, root = collections.Counter(), {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in sets.items():
        for y, common in collections.Counter(y for x in s for y in holders[x] if y != k).items():
            if 5 * common >= 4 * (len(s) + len(sets[y]) - common):
                count[k] += 1
                a, b = find(k), find(y)
                root[max(a, b)] = min(a, b)
    return {k: (find(k), count[k]) for k in texts}


@pytest.mark.parametrize("block", [256, 4])
def test_near_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    want = similar({r.doc_id: r.text for r in df.collect()})
    assert {r.doc_id: (r.class_id, r.n_links) for r in near.classes(df).collect()} == want


def test_prefix_is_shortened_to_the_recall():
    assert near.prefix_length(0.8, 0.999, 20, 6) == 5 and near.prefix_length(0.8, 0.99999999, 20, 6) < 4 and near.prefix_length(0.95, 0.999, 20, 6) == 6


def test_large_near_group(spark):
    """A group of many near copies is decided block by block, every link counted."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        words = list(base)
        words[rnd.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar(dict(rows))
    assert {r.doc_id: (r.class_id, r.n_links) for r in near.classes(df).collect()} == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("block", [16, 2048])
def test_exact_equals_brute_force(spark, block):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    by_text = collections.defaultdict(list)
    for r in df.collect():
        by_text[re.sub(r"[\x20\x09-\x0D]+", " ", r.text)].append(r.doc_id)
    want = {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by_text.items() for i in ids}
    assert {r.doc_id: tuple(r)[1:] for r in exact.groups(df, block=block).collect()} == want


@pytest.mark.parametrize("bits", [43, 6])
def test_rule_counts_equal_brute_force(docs, texts, bits):
    def count(t):
        words, seen, repeated = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        windows = list(zip(words, words[1:], words[2:]))
        often, covered = collections.Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered |= {i, i + 1, i + 2}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered)

    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.base_counts(docs, bits).collect()}
    assert got == {k: count(t) for k, t in texts.items()}


def test_rules_agree_with_labels(spark):
    df = rules.judge(spark.read.parquet(f"{MIDDLE}/documents.parquet")).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id")
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in df.groupBy("quality", "base_failed", "kept").count().collect()}
    assert n.get((0, False, True), 0) <= 0.05 * n[0, False, False] and n.get((1, False, False), 0) <= 0.02 * n[1, False, True]


def test_base_spans_equal_the_patterns():
    def plain(t):
        found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and pii.passes_luhn(digits):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))

    for t in random_texts(8000, "a.@b1 +-2.(0", longest=40) + random_texts(8000, "0123456789 -.", 2, 40):
        assert pii.base_spans(t) == plain(t), t


def test_base_columns_of_the_query(spark, texts):
    for r in load_all()["op1_personal_data"][0](spark, SMALL).collect():
        spans = pii.base_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in spans) for kind in pii.KINDS[:4])


def test_terms_that_give_a_value_away(spark):
    common = "the quick brown words about nothing special here there everywhere"
    rows = [(i, f"{common} number {i}") for i in range(200)]
    rows += [(1000 + i, f"plain {w} about zebrafish then mail ann@example.com sent with {common}") for i, w in enumerate(["north", "south", "west", "east", "middle"])]
    rows += [(2000 + i, f"a copy of one context quagga bob@example.com nothing {common}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    told = {(r.doc_id, texts[r.doc_id][s["start"] : s["end"]]) for r in pii.find(df).collect() for s in r.added}
    assert {t for _, t in told} >= {"zebrafish"} and not {t for _, t in told} & {"quagga", "words", "about", "nothing", "quick"}
    assert {i for i, t in told if t == "zebrafish"} == {1000 + i for i in range(5)}
    assert not any("zebrafish" in r.text or "@" in r.text for r in pii.sanitise(df).collect())


def test_terms_of_rare_values_are_judged(spark):
    rows = [(i, f"the quick brown words about nothing special number {i}") for i in range(3000)]
    rows += [(5000 + i, f"{w} about okapi then mail u{i}@rare.example.net sent with words") for i, w in enumerate(["north", "south", "west", "east"])]
    rows += [(6000 + i, f"{w} quokka mail twice@other.example.org sent with words") for i, w in enumerate(["up", "down"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    told = {(r.doc_id, texts[r.doc_id][s["start"] : s["end"]]) for r in pii.find(df).collect() for s in r.added}
    # Each address of the pool stands in one document; the other value in two.
    assert {i for i, t in told if t == "okapi"} == {5000 + i for i in range(4)}
    assert {i for i, t in told if t == "quokka"} == {6000, 6001} and not {t for _, t in told} & {"words", "about"}


def test_terms_are_masked_wherever_they_stand(spark):
    filler = "the quick brown words about nothing special here there everywhere " * 12
    rows = [(i, f"{filler} number {i}") for i in range(500)]
    rows += [(1000 + i, f"Okapi gnu {filler} {w} write to ann@example.com or okapi, okapis") for i, w in enumerate(["north", "south", "west", "east", "middle", "up"])]
    rows += [(2000, "one text has Okapi and no address")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    told = {(r.doc_id, s["start"], texts[r.doc_id][s["start"] : s["end"]]) for r in pii.find(df, generalise=0.7).collect() for s in r.added}
    assert all((1000 + i, 0, "Okapi") in told and (1000 + i, 6, "gnu") in told for i in range(6)) and (2000, 13, "Okapi") in told
    assert sum(t.lower() == "okapi" for *_, t in told) == 13
    assert not {t.lower() for *_, t in told} & {*filler.split()}


def plain_disclosures(texts, generalise=pii.GENERALISE, z=pii.CONFIDENCE):
    """Every pair of value and term with its disclosure, by counting over a list of texts."""
    terms = [pii.terms_of(t) for t in texts]
    held = [pii.contexts(t, pii.base_spans(t)) for t in texts]
    n_term = collections.Counter(w for t in terms for w in t)
    n_value = collections.Counter(v for h in held for v in h)
    pairs = collections.defaultdict(list)
    for t, h in zip(terms, held):
        for v, c in h.items():
            for w in t:
                pairs[v, w].append(c)
    out = {}
    for (v, w), met in pairs.items():
        k, n = len({*met}), len({*met}) + n_term[w] - len(met)
        p = k / n
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        ic = np.log(len(texts) / n_value[v])
        if k >= 2 and ic > 0 and 1 + np.log(low) / ic >= generalise:
            out[v, w] = 1 + np.log(low) / ic
    return out


def test_disclosures_equal_brute_force(spark, monkeypatch):
    """3,000 documents with addresses that share words, domains and passages; few frequent terms are known to tasks."""
    rnd = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'x' * (i // 676)}" for i in range(900)]
    rows = []
    for i in range(3000):
        words = [vocabulary[min(899, int(rnd.expovariate(1 / 120)))] for _ in range(rnd.randrange(5, 40))] + [f"only{i}"]
        if rnd.random() < 0.3:
            who = rnd.randrange(60)
            words.insert(rnd.randrange(len(words)), f"p{who}@d{who % 9}.example.org")
            words += [f"mark{who}"] * (rnd.random() < 0.8) + [f"firm{who % 9}"] * (rnd.random() < 0.9)
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, rows[7][1]) for i in range(20)] + [(6000 + i, "one passage quagga bob@copied.example.org with one context each time") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = plain_disclosures([t for _, t in rows])
    for name, value in (("FREQUENT", 50), ("PAIRED", 500)):
        monkeypatch.setattr(pii, name, value)
    got = {(r.value, r.term): r.disclosure for r in pii.disclosures(pii.mentions(df), df).collect()}
    assert set(got) == set(wanted) and len(wanted) > 50
    assert all(got[k] == pytest.approx(wanted[k]) for k in wanted)
    assert not any(w.startswith("only") or w == "quagga" for _, w in got) and {"mark3", "firm3"} <= {w for _, w in got}


def test_quality_on_held_out_rows(spark):
    rows = load_all()["op2_quality"][0](spark, MIDDLE).filter("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_language_on_held_out_rows(spark):
    rows = load_all()["op7_language"][0](spark, MIDDLE).filter("held_out").join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_lm_equals_brute_force(spark, docs, texts):
    target = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()}
    size, words = 128, collections.Counter(w for t in texts.values() for w in t.lower().split())
    known = {w: i + 2 for i, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[: size - 2])}
    ids = {k: [0, *(known.get(w, 1) for w in t.lower().split())] for k, t in texts.items()}

    def model(keys):
        both = collections.Counter(p for k in keys for p in zip(ids[k], ids[k][1:]))
        one, before, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in both.items():
            one[b] += n
            before[a] += n
            kinds[a] += 1
        total = sum(one.values())

        def loss(a, b):
            p = (one[b] + 1) / (total + size)
            return -np.log(max(both[a, b] - 0.75, 0) / before[a] + 0.75 * kinds[a] / before[a] * p if before[a] else p)

        return loss

    t, b = model(target & set(texts)), model(texts)
    got = lm.score(docs, lm.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1"), size)).collect()
    for r in got:
        pairs = list(zip(ids[r.doc_id], ids[r.doc_id][1:]))
        assert r.n_tokens == len(pairs)
        assert r.score == pytest.approx(sum(t(x, y) - b(x, y) for x, y in pairs) / max(1, len(pairs)), abs=5e-3)


def test_edited_counts_equal_a_full_encoding(library, texts):
    own, rnd = bytepairs.Encoder(TOKENIZER), random.Random(9)
    for text in [*list(texts.values())[:60], *random_texts(200, longest=60), ""]:
        places = sorted(rnd.randrange(len(text) + 1) for _ in range(2 * rnd.randrange(6)))
        made = [{"start": a, "end": b, "text": rnd.choice(["", "x", " ", "'s", "word and more", "\n\n", text[:200]])} for a, b in zip(places[::2], places[1::2])]
        after, at = [], 0
        for e in made:
            after += [text[at : e["start"]], e["text"]]
            at = e["end"]
        after = "".join(after) + text[at:]
        got = edits.apply_edits(text, made, own)
        assert (got["tokens_before"], got["n_tokens"], got["n_chars_after"], got["n_skipped"]) == (len(library(text)), len(library(after)), len(after), 0)


def test_one_edit_encodes_little(texts):
    own, text = bytepairs.Encoder(TOKENIZER), max(texts.values(), key=len)
    assert edits.apply_edits(text, [{"start": 500, "end": 505, "text": "new"}], own)["chars_encoded"] < 1000 < len(text)


def test_edit_query(spark, texts, library):
    for r in load_all()["op10_token_counts"][0](spark, SMALL).collect():
        text, out, at = texts[r.doc_id], [], 0
        for e in edits._cleaning(text):
            out += [text[at : e["start"]], e["text"]]
            at = e["end"]
        assert r.tokens_before == len(library(text)) and r.n_tokens == len(library("".join(out) + text[at:]))


def test_pipeline(spark, library):
    """Every stage against brute force on its own input."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in stages["language"](spark, docs, MIDDLE).collect()}
    content = language.dictionaries(language.training_rows(docs))
    told = {r.doc_id: language.classify(r.text, tuple(content.items())) for r in docs.collect()}
    assert set(rows) == {k for k, (lang, _, margin) in told.items() if lang != "und" and margin >= language.MARGIN} and len(rows) > 0.98 * docs.count()

    docs = spark.createDataFrame(list(rows.values()), docs.schema)
    docs = stages["exact"](spark, docs, MIDDLE)
    first = {}
    for k, r in sorted(rows.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), k)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(texts) == set(first.values())

    docs = stages["near"](spark, docs, MIDDLE)
    groups = similar(texts)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == {g for g, _ in groups.values()}

    docs = stages["pii"](spark, docs, MIDDLE)
    clean = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(clean) == {g for g, _ in groups.values()}
    for k, r in clean.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(texts[k]):
            assert r.text == texts[k]

    packed = stages["packing"](spark, docs, MIDDLE).collect()
    assert check_packing(packed, {k: r.text for k, r in clean.items()}, library) < 0.02
    assert corpus_pipeline.run(spark, MIDDLE).agg(F.sum("length")).collect()[0][0] == sum(r.length for r in packed)


def plain_differences(texts, target):
    """Mean loss differences over all words of the corpus, as the docstring defines them."""
    words = {k: ["", *t.lower().split()] for k, t in texts.items()}
    size = len({w for own in words.values() for w in own}) + 1

    def model(keys):
        both = collections.Counter(p for k in keys for p in zip(words[k], words[k][1:]))
        one, before, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for (a, b), n in both.items():
            one[b] += n
            before[a] += n
            kinds[a] += 1
        total = sum(one.values())

        def loss(a, b):
            p = (one[b] + 1) / (total + size)
            return -np.log(max(both[a, b] - 0.75, 0) / before[a] + 0.75 * kinds[a] / before[a] * p if before[a] else p)

        return loss

    t, b = model(target & set(texts)), model(texts)
    return lambda text: [t(x, y) - b(x, y) for x, y in zip(["", *text.lower().split()], text.lower().split())]


def test_lm_counts_every_word(spark, docs, texts, monkeypatch):
    """No word is left out, however rare, and words dealt over many buckets keep exact counts."""
    for name, value in (("TOKENS", 3_000), ("BUCKET", 5_000), ("OFTEN", 40)):
        monkeypatch.setattr(lm, name, value)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1")
    plain = plain_differences(texts, {r.doc_id for r in labels.collect()})
    model = lm.train(docs, labels)
    got = {r.doc_id: r for r in lm.score_corpus(model).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        wanted = plain(t)
        assert got[k].n_tokens == len(wanted) and got[k].total == pytest.approx(sum(wanted), abs=1e-6)
    other = [(1, "words that no document holds: zzyzx qwrtp zzyzx"), (2, None), (3, texts[min(texts)])]
    rows = lm.score(spark.createDataFrame(other, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.total for r in rows} == pytest.approx({k: sum(plain(t or "")) for k, t in other}, abs=1e-6)


def test_lm_tells_rare_words_apart(spark):
    """Two texts that differ only in words outside the 4,094 most frequent get different scores."""
    rows = [(i, " ".join(f"w{j}" for j in range(4500))) for i in range(2)] + [(2000, "zeta eta"), (2001, "theta iota")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(df, spark.createDataFrame([(2000,), (1,)], "doc_id long"))
    got = {r.doc_id: r.score for r in lm.score(df, model).collect()}
    assert got[2000] < got[2001] - 0.5
