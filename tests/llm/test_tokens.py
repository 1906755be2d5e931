"""SentencePiece and byte-level BPE ids, packing, separator scan."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from revcast.llm import piece_codec, separator_scan, two_fit_packing
from revcast.llm.byte_bpe import WordwiseTokenizer
from revcast.llm.common import fresh_path
from tests.llm.helpers import awkward, awkward_rows, empty

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", " ", "  ", "a", "the", "Word", ".", ",", "\n", "\t", "'s", "don't", "1", "23", "é", "中", "😀", "▁", "\x00", "\x85",
         " ", "<s>", "<|endoftext|>", "<0x41>", "ing", "###", "aaaa", "ª", "Ж", "\r\n", "�"]


def texts(n: int, seed: int):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_pieces_equal_the_library():
    codec, sp = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [*texts(5000, 1), "a" * 9000, " " * 700 + "b", "x y" * 500, *(r[1] or "" for r in awkward_rows())]:
        ids = sp.encode(text)
        assert codec.encode(text) == ids, text[:80]
        joined, decoded = codec.encode_and_decode(text)
        assert joined == ",".join(map(str, ids)) and decoded == sp.decode(ids) == codec.decode(ids)


def test_decoding_any_ids_equals_the_library():
    codec, sp = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    for _ in range(4000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == sp.decode(ids), ids


def test_new_words_cost_few_steps_and_long_runs_are_cut_in_windows():
    codec, sp = piece_codec.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(4)
    words = ["".join(draw.choice(["th", "er", "in", "on", "wh", "ou", "an", "e", "s", "x", "é"]) for _ in range(5)) for _ in range(2000)]
    for run in ("".join(words), "中".join(words[:300]), "=" * 700, "the" * 500, "0" * 999):
        assert codec.encode(run) == sp.encode(run)
    codec, steps = piece_codec.PieceCodec(PIECES), 0

    def step(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    codec.encode_and_decode(" ".join(words))  # what pairs of pieces merge to is known then
    codec.words.clear()
    sys.setprofile(step)
    try:
        codec.encode_and_decode(" ".join(words))
    finally:
        sys.setprofile(None)
    assert steps < 55 * len(set(words)), steps / len(set(words))


def test_piece_digests_and_round_trip(spark):
    docs = awkward(spark)
    rows = piece_codec.digests(docs, PIECES).collect()
    assert len(rows) == docs.count()
    null = next(r for r in rows if r.doc_id == 1)
    assert null.n_tokens == 0 and null.ids_sha256 == null.decoded_sha256
    assert piece_codec.digests(empty(spark), PIECES).count() == 0
    back = piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES)
    got = Counter((r.doc_id, r.text) for r in back.collect())
    # A text gives itself back, but for the sign that stands for a space.
    assert got == Counter((r[0], (r[1] or "").replace("▁", " ")) for r in awkward_rows())


def test_bytes_equal_the_library():
    own, lib = WordwiseTokenizer(BYTES), Tokenizer.from_file(BYTES)
    for text in [*texts(8000, 2), *(r[1] or "" for r in awkward_rows())]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]
    assert own.encode(None) == b""


def test_added_tokens_equal_the_library():
    own, lib = WordwiseTokenizer(BYTES), Tokenizer.from_file(BYTES)
    signs = [t.content for t in lib.get_added_tokens_decoder().values()]
    assert signs
    rng = random.Random(6)
    for text in [*texts(400, 5), "", "a", " a  b\n"]:
        for _ in range(3):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", " ", "\n"]) + rng.choice(signs) + rng.choice(["", " ", "  ", "x"]) + text[at:]
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (17, [(0, 1), (1, 8), (9, 8)])])
def test_cut(n, want):
    assert two_fit_packing.cut(n, 8) == want


def test_two_fit_swaps_the_smallest_for_two():
    # 6 leaves a gap of 4; greedy takes 3 (gap 1); 2 + 2 fill the expanded gap of 4 exactly.
    plan = two_fit_packing.plan({6: 1, 3: 1, 2: 2}, 10)
    first = plan[plan.bin == 0]
    assert sorted(zip(first.length, first.total, strict=True)) == [(2, 2), (6, 1)]
    assert (plan.bin + plan.total // plan.each).max() == 2


def test_plan_covers_every_piece_and_is_tight():
    rng = random.Random(8)
    counts = Counter(min(2048, 1 + int(rng.expovariate(1 / 500))) for _ in range(30_000))
    plan = two_fit_packing.plan(dict(counts))
    for length, own in plan.sort_values("first").groupby("length"):
        assert own["first"].tolist() == [0, *own["total"].cumsum().tolist()[:-1]] and own["total"].sum() == counts[length]
    bins = int((plan.bin + plan.total // plan.each).max())
    assert bins <= 1.002 * -(-sum(k * v for k, v in counts.items()) // 2048) + 1


def check_packing(rows, docs_rows, capacity):
    lib = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc_id, text, *_ in docs_rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(two_fit_packing.cut(len(ids), capacity)):
            want[doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / capacity + 1


def test_packing_awkward_rows(spark):
    pieces = two_fit_packing.pieces(awkward(spark), BYTES, with_ids=True)
    packed = two_fit_packing.pack(pieces, bucket_rows=10)
    rows = packed.collect()
    check_packing(rows, awkward_rows(), 2048)
    flat = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in two_fit_packing.sequences(packed).collect()}
    for r in rows:
        n, ids = flat[r.sequence_id]
        assert len(ids) == 4 * n and ids[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert two_fit_packing.pack_documents(empty(spark), BYTES).count() == 0


def brute_documents(tokens, end):
    out, start = [], 0
    for k, t in enumerate(tokens):
        if t == end:
            out.append((start, k - start, True))
            start = k + 1
    if start < len(tokens):
        out.append((start, len(tokens) - start, False))
    return out


@pytest.mark.parametrize("block, scan", [(2, 4096), (6, 2), (64, 3), (4 << 20, 4096)])
def test_separator_scan_equals_brute_force(spark, tmp_path, monkeypatch, block, scan):
    monkeypatch.setattr(separator_scan, "SCAN_BLOCKS", scan)
    rng = np.random.default_rng(block)
    want = Counter()
    for name, n, ends in (("a", 50, 0.3), ("b", 41, 0.02), ("c", 30, 0.0), ("d", 9, 1.0), ("e", 0, 0)):
        tokens = np.where(rng.random(n) < ends, 7, rng.integers(8, 99, n)).astype("<u2")
        (tmp_path / f"{name}.bin").write_bytes(tokens.tobytes())
        for k, (start, length, complete) in enumerate(brute_documents(tokens, 7)):
            want[name, k, start, length, complete] += 1
    found = separator_scan.count_tokens(spark, f"file://{tmp_path}", end_id=7, block_bytes=block).collect()
    assert Counter((r.file[-5], r.doc_index, r.start, r.n_tokens, r.complete) for r in found) == want


def test_flat_files_hold_every_document(spark):
    path = fresh_path(spark, "flat-test")
    separator_scan.write_flat(awkward(spark), BYTES, path)
    found = separator_scan.count_tokens(spark, path).collect()
    own = WordwiseTokenizer(BYTES)
    assert Counter(r.n_tokens for r in found) == Counter(len(own.encode(r[1])) // 4 for r in awkward_rows())
    assert all(r.complete for r in found)
    nothing = fresh_path(spark, "flat-test")
    separator_scan.write_flat(empty(spark), BYTES, nothing)
    assert separator_scan.count_tokens(spark, nothing).count() == 0


def test_a_torn_file_is_refused(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        separator_scan.count_tokens(spark, f"file://{tmp_path}").collect()
