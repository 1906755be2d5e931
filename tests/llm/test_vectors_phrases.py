"""Nearest vectors, whitening and collocations against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from revcast.llm import block_whitening, multi_index, pair_tiles
from tests.llm.helpers import CLASHING, awkward, empty

VECTORS = "vec_id long, embedding array<float>, " + ", ".join(f"{c} string" for c in [*CLASHING, "index", "vector", "code", "block", "pos"])
EXTRA = ("x",) * (len(CLASHING) + 5)


def vector_rows(n: int = 400, d: int = 12, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)).astype(np.float32)
    base[50:150] = base[50]  # a hot vector
    base[150:200] = base[150:200] / 8 + base[3]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * d, [1.0, None] + [0.0] * (d - 2), [nan] + [1.0] * (d - 1), [inf] + [1.0] * (d - 1), [-inf] * d, [1.0] * (d - 1)]
    rows += [(n + 20 * k, v) for k, v in enumerate(odd)]
    return [(i, v, *EXTRA) for i, v in rows]


def usable(rows, d: int = 12):
    return [(r[0], np.array(r[1], dtype=np.float64)) for r in rows if r[1] and len(r[1]) == d and None not in r[1] and np.isfinite(r[1]).all()]


def brute_nearest(rows, k: int, every: int):
    own = [(i, v) for i, v in usable(rows) if i is not None and v.any()]
    out = {}
    for i, q in own:
        if i % every == 0:
            others = sorted((-float((v * q).sum()), j) for j, v in own if j != i)
            out[i] = [(j, -s) for s, j in others[:k]]
    return out


def test_nearest_equals_brute_force_within_the_radius(spark):
    rows = vector_rows()
    got: dict[int, list] = {}
    for r in multi_index.nearest(spark.createDataFrame(rows, VECTORS).repartition(5), k=20, every=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    caught = total = 0
    for i, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, 21))
        assert [x[1:] for x in near] == sorted((x[1:] for x in near), key=lambda x: (-x[1], x[0]))
        exact = dict(want[i])
        caught += len(exact.keys() & {x[1] for x in near})
        total += len(exact)
        assert all(abs(exact[j] - s) < 1e-12 for _, j, s in near if j in exact)
    assert caught >= 0.95 * total


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, size=(3000, multi_index.BITS // 8), dtype=np.uint8)
    codes[:200] = codes[0]
    flips = rng.integers(0, 2**8, size=(400, 2))
    for k, (a, b) in enumerate(flips):
        codes[500 + k] = codes[0]
        codes[500 + k, k % 16] ^= np.uint8(a)
        codes[500 + k, (k * 7) % 16] ^= np.uint8(b)
    block = multi_index.Block(codes)
    apart = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
    for radius in (0, 1, 5, 8, 20, 55, 64, 128):
        assert sum(max(0, r + 1) for r in multi_index.radii(radius)) in (radius + 1, multi_index.TABLES * (multi_index.SUBSTRING + 1))
        assert set(block.within(codes[0], radius)) == set(np.flatnonzero(apart <= radius))


def test_nearest_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.nearest(few).collect()]
    assert sorted(got) == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert multi_index.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert multi_index.nearest(few.filter("vec_id = 0")).count() == 0


def test_nearest_of_unequal_lengths(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)) * rng.choice([0.1, 1.0, 3.0], size=(600, 1))
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(x)]
    got: dict[int, set] = {}
    for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    recall = np.mean([len(got[i] & set(np.argsort(-scores[i])[:20])) / 20 for i in range(0, 600, 20)])
    assert recall >= 0.9


def test_whitening_equals_numpy(spark):
    rows = vector_rows() + [(None, [0.25] * 12, *EXTRA), (7, [0.5] * 12, *EXTRA)]
    own = usable(rows)
    x = np.floor(64 * np.array([v for _, v in own])) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, mean = len(distinct), distinct.mean(axis=0)
    values, axes = np.linalg.eigh((distinct - mean).T @ (distinct - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    sums = distinct.astype(int).sum(axis=0)
    white = (x - mean) @ axes / np.sqrt(values)
    got = block_whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert len(got) == len(own) * 12
    want = Counter(
        (i, c + 1, round(abs(w[c]), 7), int(((n * row.astype(int) - sums) ** 2).sum()))
        for (i, _), row, w in zip(own, x, white, strict=True)
        for c in range(12)
    )
    assert Counter((r.vec_id, r.component, round(abs(r.whitened), 7), r.deviation) for r in got) == want
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_whitening_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert block_whitening.whiten(frame([])).count() == 0
    assert block_whitening.whiten(frame([(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0
    # One direction of variation: one component.
    got = block_whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1e30, 0.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.n) for r in got) == [(1, 1, 1.0, 2), (2, 1, 1.0, 2), (2, 1, 1.0, 2)]


def test_whitening_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [float(a) for a in v]) for k, v in enumerate(rng.normal(size=(700, 10)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = {(r.vec_id, r.component): abs(r.whitened) for r in block_whitening.whiten(frame).collect()}
    monkeypatch.setattr(block_whitening, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(block_whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(block_whitening, "SPLIT_BLOCKS", 3)
    cut = {(r.vec_id, r.component): abs(r.whitened) for r in block_whitening.whiten(frame).collect()}
    assert cut.keys() == whole.keys() and all(abs(cut[k] - whole[k]) < 1e-8 for k in whole)


def brute_collocations(rows, least: int, top: int):
    low = {c: c + 32 for c in range(65, 91)}
    by_lang: dict[str, list[str]] = {}
    for text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(text or "")
    out = []
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(low)):
                w = [x for x in re.split("[ \t]+", piece) if x]
                n += len(w)
                for size in range(1, 5):
                    for k in range(len(w) - size + 1):
                        f[tuple(w[k : k + size])] += 1
        phrases = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in phrases.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    if 100 * a >= 80 * phrases[p[k : k + size]]:
                        inside.add(p[k : k + size])
        table = []
        for p, a in phrases.items():
            if p not in inside:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                table.append((-score, -a, " ".join(p).encode(), l, r))
        table.sort()
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(table[:top])]
    return sorted(out)


def phrase_rows(seed: int = 2):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(30)] + ["É", "中文", "A", "a", "#", "\x00", "x y"]
    weights = 1.0 / np.arange(1, len(words) + 1)
    rows = [(None, "en"), ("", "en"), (" . \t;", "en"), ("one", None), ("one two", "und"), ("one two", None)]
    for lang in ("en", "fr", None, "und"):
        for _ in range(60):
            row = rng.choice(words, size=rng.integers(1, 120), p=weights / weights.sum())
            gaps = rng.choice([" ", "\t", "  ", ". ", ",", "\n", " ! ", "\r"], size=len(row), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
            rows.append(("".join(a + b for a, b in zip(row, gaps, strict=True)), lang))
    rows += [("New York City hall " * 9, "en")] * 5 + [("la la la la la la la", "fr")] * 9
    return rows


def collocation_rows(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, *EXTRA) for t, g in rows], "text string, lang string, " + ", ".join(f"c{k} string" for k in range(len(EXTRA)))).repartition(5)
    for least, top in ((30, 2000), (3, 40)):
        assert collocation_rows(pair_tiles.collocations(docs, least, top)) == brute_collocations(rows, least, top)
    # The same from bitmaps that are too small to rule much out.
    monkeypatch.setattr(pair_tiles, "MOST_BITS", 10)
    monkeypatch.setattr(pair_tiles, "BITS_EACH", 1)
    assert collocation_rows(pair_tiles.collocations(docs, 5, 100)) == brute_collocations(rows, 5, 100)


def test_collocations_of_awkward_rows(spark):
    docs = awkward(spark)
    got = collocation_rows(pair_tiles.collocations(docs, 5))
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert got == brute_collocations(rows, 5, 2000)
    assert pair_tiles.collocations(empty(spark)).count() == 0


def test_tiles_count_like_a_table(monkeypatch):
    for side in (pair_tiles.TILE, 4):
        monkeypatch.setattr(pair_tiles, "TILE", side)
        tiles_like_a_table()


def tiles_like_a_table():
    rng = np.random.default_rng(4)
    left = np.minimum(rng.zipf(1.3, 300_000), 9000) - 1
    right = np.minimum(rng.zipf(1.3, 300_000), 9000) - 1
    a, b, n = pair_tiles.tile_counts(left, right)
    assert Counter(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))) == Counter(zip(left.tolist(), right.tolist(), strict=True))
    assert len(a) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
