"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A merge-type encoding is the only split of a text into pieces in which every
two neighbours are compatible: merging the characters of the two from scratch
gives just these two back.  So the encoder needs no merge queue over the text.
It takes the longest piece at each position (an Aho-Corasick automaton finds
them), keeps it if it is compatible with the piece before, tries the shorter
pieces that it starts with if not, and steps back when none fits.  A bitfield
marks positions from which no split of the rest exists, so that none is tried
twice and the work stays in proportion to the text.

Where no piece holds a space after another character, no merge crosses from a
word to the space behind it.  Texts are then cut there first, and each task
remembers the pieces of words it has met.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Entries that a task's memories of words and of pairs hold before they start anew.
WORDS_KEPT, PAIRS_KEPT = 300_000, 400_000
#: Longer words are not remembered.
LONGEST_KEPT = 64
#: Characters of a long run that the automaton gets at a time.
WINDOW = 256

_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class _Memory(dict):
    """word -> (its ids joined by commas, its decoded text); what the last
    ``WORDS_KEPT`` new words left behind moves to ``old`` and is dropped next time."""

    def __init__(self, codec: "PieceCodec"):
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.old.get(word)
        if found is None:
            found = self.codec.coded_run(SPACE + word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= WORDS_KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model file.

    The library is used to read the vocabulary only.  Models that normalise
    text are refused; the identity rule with a leading space is what this
    encoder implements.
    """

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if sp.normalize("a  Åﬁ ") != f"{SPACE}a{SPACE}{SPACE}Åﬁ{SPACE}":
            raise ValueError("only models with the identity rule and a leading space are supported")
        size = sp.get_piece_size()
        self.piece: list[str] = [sp.id_to_piece(i) for i in range(size)]
        self.byte_value = {i: int(self.piece[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.byte_id = {v: i for i, v in self.byte_value.items()}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        special = self.silent | self.byte_value.keys() | {self.unknown}
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.id_of_set = set(self.id_of.values())
        #: What each id alone decodes to; bytes do not alone.
        self.shown = [None if i in self.byte_value else " ⁇ " if i == self.unknown else "" if i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        # A space inside a piece follows spaces only: no merge joins a word to the next space.
        self.splits_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.longest = max(map(len, self.id_of))
        #: The shorter pieces that a piece starts with, the longest first; its first character always.
        self.shorter = {p: (*(p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.id_of), p[0]) for p in self.id_of if len(p) > 1}
        self.shorter |= {p: () for p in self.id_of if len(p) == 1}
        self.digits = list(map(str, range(size)))
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Memory(self)

    # ---- encoding -----------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging from single characters: the best
        score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best[0]):
                    best = score, k
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        """Whether the two stay what they are when merged anew side by side
        (``before`` is empty at the start of a run)."""
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.merge(before + piece) == ([before, piece] if before else [piece])
            self.pairs[before, piece] = known
        return known

    def split_run(self, run: str) -> list[str]:
        """The pieces of a run, by backtracking."""
        n, known = len(run), self.pairs.get
        failed = None  # a bit for each position, made when the first one fails
        taken: list[str] = []
        before, at = "", 0
        while at < n:
            # The longest pieces, as long as they are compatible.
            low, part = (at, run[at : at + WINDOW]) if n > WINDOW else (0, run)
            sure = n if low + len(part) == n else low + len(part) - self.longest  # from there on, longer ones may reach out of the part
            p = None
            for end, p in self.automaton.iter_long(part, at - low):
                end += low + 1
                if end - len(p) != at or at > sure:
                    p = None
                    break
                if failed is not None and failed[end >> 3] & (1 << (end & 7)):
                    break
                fits = known((before, p))
                if not (self.compatible(before, p) if fits is None else fits):
                    break
                taken.append(p)
                before, at, p = p, end, None
            if at >= n:
                break
            if p is None and at > sure:
                continue
            # Shorter ones; a character can stand alone without a piece of its own.
            shorter = (run[at],) if p is None else self.shorter[p]
            while True:
                for p in shorter:
                    end = at + len(p)
                    if (failed is None or not failed[end >> 3] & (1 << (end & 7))) and self.compatible(before, p):
                        break
                else:
                    if not taken:
                        raise ValueError("no split found")  # cannot happen: the merges give one
                    if failed is None:
                        failed = bytearray(n // 8 + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    last = taken.pop()
                    at -= len(last)
                    before = taken[-1] if taken else ""
                    shorter = self.shorter.get(last, ())
                    continue
                taken.append(p)
                before, at = p, end
                break
        return taken

    def encode_run(self, run: str) -> list[int]:
        pieces = self.split_run(run)
        try:
            return [self.id_of[p] for p in pieces]
        except KeyError:  # a character without a piece of its own
            pass
        ids: list[int] = []
        for p in pieces:
            known = self.id_of.get(p)
            if known is not None:
                ids.append(known)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unknown)
        return ids

    def coded_run(self, run: str) -> tuple[str, str]:
        """The ids of a run joined by commas, and what they decode to."""
        ids = self.encode_run(run)
        return ",".join([self.digits[i] for i in ids]), self.text_of(ids)

    def _coded(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        if self.splits_at_space and "  " not in text and SPACE not in text and text[0] != " ":
            return list(map(self.words.__getitem__, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        runs = _RUNS.findall(marked) if self.splits_at_space else [marked]
        coded = []
        for run in runs:
            if run[0] == SPACE and run[1:2] != SPACE:
                coded.append(self.words[run[1:]])
            else:
                coded.append(self.coded_run(run))
        return coded

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without begin or end ids; null counts as empty."""
        return [int(x) for ids, _ in self._coded(text or "") for x in ids.split(",")]

    # ---- decoding -----------------------------------------------------
    def text_of(self, ids: list[int]) -> str:
        """The text of ids inside a sequence, spaces kept."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # bytes join to characters
            pass
        out: list[str] = []
        waiting = bytearray()
        for i in ids:
            value = self.byte_value.get(i)
            if value is not None:
                waiting.append(value)
                continue
            if waiting:
                out.append(_utf8(bytes(waiting)))
                waiting.clear()
            out.append(self.shown[i])
        if waiting:
            out.append(_utf8(bytes(waiting)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a whole sequence: without the space that encoding puts first."""
        text = self.text_of(ids)
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return text.removeprefix(" ") if first in self.id_of_set and self.piece[first][0] == SPACE else text

    def encode_and_decode(self, text: str | None) -> tuple[str, str]:
        """The ids joined by commas, and the text that decoding gives back."""
        coded = self._coded(text or "")
        return ",".join([x[0] for x in coded]), "".join([x[1] for x in coded]).removeprefix(" ")


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is not part of a character becomes U+FFFD."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + size].decode("utf-8"))
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


_OPEN: dict[str, PieceCodec] = {}


def codec_of(model_file: str) -> PieceCodec:
    """The codec of this worker process for a model file."""
    if model_file not in _OPEN:
        _OPEN[model_file] = PieceCodec(model_file)
    return _OPEN[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids array<int>`` for each row of ``docs`` (``doc_id``, ``text``)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = codec_of(model_file)
        return pd.Series([codec.encode(x) for x in texts])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids("text").alias("ids"))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` for each row of ``encoded`` (``doc_id``, ``ids``); null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = codec_of(model_file)
        return pd.Series([codec.decode([int(i) for i in x]) if x is not None else "" for x in ids])

    return encoded.select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null or empty text has no ids and decodes to the empty text.  Repeated
    rows each get a row, an empty table gives none, other columns are not read.
    The model file must lie at the same path on every executor.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model_file)
        for part in texts:
            rows = []
            for text in part:
                ids, decoded = codec.encode_and_decode(text)
                rows.append(
                    (
                        ids.count(",") + 1 if ids else 0,
                        hashlib.sha256(ids.encode()).hexdigest(),
                        hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(),
                    )
                )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("__d"))
    return found.select("doc_id", "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")
