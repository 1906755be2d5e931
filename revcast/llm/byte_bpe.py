"""Byte-level BPE ids by the tokenizers library, remembered word by word.

The vocabulary's pattern never joins a character to a single space behind it,
so a text can be cut in front of such spaces and each part encoded alone.  Most
parts are words met before; only new ones go through the library.  A text that
holds the sign of an added token goes through it whole.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

#: New words that a task remembers before the older half is dropped; longer words are not kept.
WORDS_KEPT, LONGEST_KEPT = 300_000, 64

# A space with white space on both sides (or at the end) is part of a run that the pattern joins.
_INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")
_RUN_STARTS = [c + " " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"]
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


# ASCII signs that may follow a word; the apostrophe is left out, as the pattern has words with it.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Memory(dict):
    """part of a text -> its ids as little-endian unsigned 32-bit numbers"""

    def __init__(self, owner: "WordwiseTokenizer", lead: str):
        self.owner, self.lead, self.old = owner, lead, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.find(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def find(self, word: str) -> bytes:
        """The pattern cuts around a single line end between words and between Latin
        letters and signs, so these parts are looked up by themselves."""
        first = self.owner.first
        head, _, rest = word.partition("\n")
        if rest and head and not head[-1].isspace() and not rest[0].isspace():
            return self[head] + first["\n"] + first[rest]
        stem = word.rstrip(_SIGNS)
        if not stem.isalpha() or not (stem.isascii() or max(stem) <= "\u024f"):
            return packed(self.owner.tokenizer.encode(self.lead + word, add_special_tokens=False).ids)
        if len(stem) < len(word):
            return self[stem] + first[word[len(stem) :]]
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        spelled = _SPACE + spelled if self.lead else spelled
        return packed([t.id for t in self.owner.tokenizer.model.tokenize(spelled)])


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if
    printable in Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 0x100 + k for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_SPACE = chr(_BYTE_LETTERS[0x20])


class WordwiseTokenizer:
    """Ids of whole texts, equal to the library's for the whole text."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if self.tokenizer.normalizer is not None:
            raise ValueError("only tokenizers that do not normalise are supported")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first, self.rest = _Memory(self, ""), _Memory(self, " ")

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; null counts as empty."""
        if not text:
            return b""
        if any(map(text.__contains__, self.added)):
            # Added tokens are found before the pattern cuts, so such a text goes through the library whole.
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        may_run = any(map(text.__contains__, _RUN_STARTS)) if text.isascii() else True
        parts = _BETWEEN_WORDS.split(text) if may_run and _INSIDE_RUN.search(text) else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


_OPEN: dict[str, WordwiseTokenizer] = {}


def tokenizer_of(tokenizer_file: str) -> WordwiseTokenizer:
    """The tokenizer of this worker process for a file."""
    if tokenizer_file not in _OPEN:
        _OPEN[tokenizer_file] = WordwiseTokenizer(tokenizer_file)
    return _OPEN[tokenizer_file]
