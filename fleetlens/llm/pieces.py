"""SentencePiece encoding and decoding for merge-type models, without the library on the main path.

A text is cut where no piece of the vocabulary can lie across, so each stretch is
encoded alone: an agenda of adjacent symbol pairs, ordered by score and then by
place, is merged until no pair forms a piece. Every stretch that a task meets for
the first time is checked against the sentencepiece library, once per Arrow batch.

Defined results: a null text counts as empty and has no ids; rows are encoded one by
one, so repeated rows give repeated results; columns besides the key and the text
are ignored; an empty table gives an empty result. Memory of a task is one Arrow
batch and a bounded memory of stretches.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import query

MARK = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
UNKNOWN_TEXT = " ⁇ "  # what the library decodes an unknown id to
#: Stretches a task remembers, and the longest one worth it; both bound memory only.
REMEMBERED, LONGEST = 250_000, 64


def _one_byte(error):
    return "�", error.start + 1


codecs.register_error("byte-by-byte", _one_byte)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a merge-type model with the identity rule and a leading space is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.text_of = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.bytes_of = []
        for p in model.pieces:
            if p.type == BYTE:
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            else:
                text = UNKNOWN_TEXT if p.type == UNKNOWN else "" if p.type == CONTROL else p.piece.replace(MARK, " ")
                self.bytes_of.append(text.encode())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a piece goes on after a word's end")
        # Signs of pieces that join letters or digits with others: texts that hold one are cut at spaces only.
        joined = [p for p in self.rank if re.search(r"[^\W_](?:[^\w▁]|_)|(?:[^\w▁]|_)[^\W_]", p)]
        rare = {c for p in joined for c in p if ord(c) > 127}
        if any(not rare & set(p) for p in joined):
            raise ValueError("a piece joins letters with ASCII signs")
        self.coarse = re.compile("[" + re.escape("".join(sorted(rare | {MARK}))) + "]")
        self.fine_cut = re.compile(r" *[^\W_]+| *(?:[^\w ]|_)+| +")
        self.coarse_cut = re.compile(r" *[^ ]+| +")
        self.known: dict[str, bytes] = {}

    def merge(self, stretch: str) -> list[int]:
        """Ids of one stretch, spaces written as they are."""
        symbols = list(stretch.replace(" ", MARK))
        n, get = len(symbols), self.rank.get
        agenda = [(hit[0], i, hit[1], i + 1) for i, hit in enumerate(map(get, map(add, symbols, symbols[1:]))) if hit]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, piece, j = heapq.heappop(agenda)
            if after[i] != j or symbols[i] + symbols[j] != self.text_of[piece]:
                continue  # one side has been merged otherwise meanwhile
            symbols[i] = self.text_of[piece]
            after[i], after[j] = k, _ = after[j], -1
            if k < n:
                before[k] = i
                if hit := get(symbols[i] + symbols[k]):
                    heapq.heappush(agenda, (hit[0], i, hit[1], k))
            if (h := before[i]) >= 0 and (hit := get(symbols[h] + symbols[i])):
                heapq.heappush(agenda, (hit[0], h, hit[1], i))
        ids, i = [], 0
        while i < n:
            if hit := get(symbols[i]):
                ids.append(hit[1])
            else:
                ids += [self.of_byte[b] for b in symbols[i].encode()] if self.of_byte else [self.unknown]
            i = after[i]
        return ids

    def cut(self, text: str) -> list[str]:
        """Stretches of a text with its leading space; no piece lies across two of them."""
        if not text:
            return []
        text = " " + text
        if self.coarse.search(text):
            return self.coarse_cut.findall(text.replace(MARK, " "))
        return self.fine_cut.findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers; new stretches are checked against the library."""
        known, out = self.known, []
        fresh: dict[str, list[int]] = {}
        if len(known) > REMEMBERED:
            known.clear()
        long_ones: dict[str, bytes] = {}
        for text in texts:
            stretches = self.cut(text)
            for s in {*stretches}.difference(known):
                if s not in long_ones:
                    fresh[s] = ids = self.merge(s)
                    (known if len(s) <= LONGEST else long_ones)[s] = array("i", ids).tobytes()
            if long_ones:
                out.append(b"".join(known[s] if s in known else long_ones[s] for s in stretches))
            else:
                out.append(b"".join(map(known.__getitem__, stretches)))
        self.check(fresh)
        return out

    def check(self, fresh: dict[str, list[int]]) -> None:
        """Compare stretches with the library, each after a letter or a stop where it doesn't begin with a space."""
        texts, wanted = [], []
        leads = {"": [], ".": self.merge(" ."), "a": self.merge(" a")}
        for s, ids in fresh.items():
            lead = "" if s[0] == " " else "." if s[0].isalnum() else "a"
            texts.append(lead + s if lead else s[1:])
            wanted.append(leads[lead] + ids)
        for text, ids, theirs in zip(texts, wanted, self.library.encode(texts, num_threads=1)):
            if text and ids != theirs:
                raise ValueError(f"ids differ from the library's for {text!r}: {ids} and {theirs}")

    def decode(self, ids) -> str:
        """Text of ids; bytes that form no character become one replacement sign each."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        text = data.decode("utf-8", "byte-by-byte")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            flat = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in flat)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(flat), "i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the text of their ids; null ids give a null text."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            ids = batch.column(1)
            values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            held = ids.is_valid().to_pylist()
            texts = [own.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], held)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    rows = encoded.select(F.col(key).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digest_of_ids(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


@query("op8_sentence_pieces")
def op8_sentence_pieces(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model), model)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
