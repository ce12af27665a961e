"""Byte-level pair encoding of many texts with one tokenizer file.

A text is split into pre-tokens, which the tokenizer never joins, and the ids of each
pre-token are remembered. The vocabulary of the tokenizers file is used; ids equal
those of the tokenizers library: by ``encode`` with special tokens' strings as ordinary
text, by ``encode_marked`` with these as the tokens they name, as the library does unless
told otherwise.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Pre-tokens a task remembers and the longest one worth it; both bound memory only.
REMEMBERED, LONGEST = 150_000, 64

# The letters, digits and spaces up to U+024F, of which the splitting pattern of byte-level files consists.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼½¾"
SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
SPLIT = re.compile(
    rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGITS}]+| ?[^{LETTERS}{DIGITS}{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEYOND = re.compile("[^\x00-ɏ]")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in the file, by the files' own rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Pre-tokens and ids by one tokenizers file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described["pre_tokenizer"]
        if described["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level file without normaliser and leading space is needed")
        byte_of = _byte_of()
        special = {t["content"] for t in described["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in described["model"]["vocab"].items() if piece not in special}
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.merger = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"]):
            raise ValueError("special tokens that take the space around them are not known here")
        self.marks = {t["content"]: array("i", [t["id"]]).tobytes() for t in described["added_tokens"]}
        self.marked = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text, in order; together they are the text."""
        if BEYOND.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def ids_of(self, piece: str) -> bytes:
        """Ids of one pre-token as 32-bit integers."""
        found = self.known.get(piece)
        if found is None:
            found = array("i", self.merger._encode_single_piece(piece)).tobytes() if len(piece) < 1000 else array("i", self.merger.encode_ordinary(piece)).tobytes()
            if len(piece) <= LONGEST:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        pieces = self.split(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return b"".join(map(self.ids_of, pieces))

    def encode_marked(self, text: str) -> bytes:
        """The same, with special tokens' strings as those tokens; what is between them is encoded by itself."""
        if not self.marked or not any(m in text for m in self.marks):
            return self.encode(text)
        return b"".join(self.marks.get(part) or self.encode(part) for part in self.marked.split(text) if part)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
