"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from revcast.llm import exact_dedup, hyperminhash, phrase_automata
from revcast.llm.components import components
from tests.llm.helpers import SCHEMA, awkward, awkward_rows, empty, near_components, prose, removed_words

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_exact_dedup_awkward_rows(spark):
    index = exact_dedup.new_index(spark)
    got = index.load(awkward(spark)).collect()
    rows = [(r[0], (r[1] or "").translate(UPPER)) for r in awkward_rows()]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text, []).append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).digest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    kept = Counter(bytes(r.digest) for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_only_lowers_ascii(spark):
    docs = spark.createDataFrame([(1, "É A"), (2, "é a"), (3, "É a")], "doc_id long, text string")
    kept = {r.doc_id for r in exact_dedup.new_index(spark).load(docs).collect() if r.kept}
    assert kept == {2, 3}


def test_a_second_load_meets_the_index(spark):
    index = exact_dedup.new_index(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.load(frame([(1, "a"), (2, "b")])).collect()
    second = {r.doc_id: r for r in index.load(frame([(3, "B"), (4, "c"), (5, "c")])).collect()}
    assert not second[3].kept and second[3].keep_id == 2 and second[5].kept and not second[4].kept
    assert index.read().count() == 3
    assert index.load(frame([])).count() == 0
    plan = index.unseen(spark.createDataFrame([(b"x",)], "digest binary"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_load_run_again_gives_the_same(spark):
    index = exact_dedup.new_index(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (None, "b")], "doc_id long, text string")
    told = lambda rows: sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    first = told(index.load(docs, "monday"))
    assert first == [(0, 3, 2, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True)]
    # The job that used the verdicts was lost after the append.
    assert told(index.load(docs, "monday")) == first and index.read().count() == 2
    assert sorted(r.doc_id for r in exact_dedup.keep_unique(docs, index, "monday").collect()) == [2, 3]
    later = docs.unionByName(spark.createDataFrame([(9, "c")], docs.schema))
    assert [r[0] for r in told(index.load(later, "tuesday")) if r[3]] == [9] and index.read().count() == 3
    kept = index.load(later, "tuesday")
    index.drop()
    assert not index.exists() and [r[0] for r in told(kept) if r[3]] == [9]


def test_heavy_digests_are_broadcast(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', if(id % 3 = 1, 'Warm', cast(id AS string))) AS text")
    plans = []
    for share in (2, 50, 10**9):  # no digest, two, all
        monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
        out = exact_dedup.new_index(spark).load(docs)
        rows = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in out.collect()}
        assert rows == {i: ((3999, 1334, i == 3999), (3997, 1333, i == 3997), (i, 1, True))[i % 3] for i in range(4000)}
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert all("BroadcastHashJoin" in p and "SortMergeJoin" in p for p in plans)


def test_keep_unique(spark):
    docs = awkward(spark)
    out = exact_dedup.keep_unique(docs, exact_dedup.new_index(spark))
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(UPPER) for r in out.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {(r[1] or "").translate(UPPER) for r in awkward_rows()}
    assert exact_dedup.keep_unique(empty(spark), exact_dedup.new_index(spark)).count() == 0


def family_rows(seed: int, n: int = 60):
    """Near copies around the threshold, with chains."""
    rng = random.Random(seed)
    rows = []
    for f in range(6):
        words = prose(rng, rng.choice([8, 30, 150]), 3000).split()
        for k in range(n // 6):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(9999)}"
            words = own if rng.random() < 0.4 else words
            rows.append((f * 1000 + k, " ".join(own)))
    return rows


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = family_rows(1) + [(r[0], r[1]) for r in awkward_rows()]
    rows = [(i if i is None or i < 1000 else i + 5000, t) for i, t in rows]
    rows = list({i: (i, t) for i, t in rows if i is not None}.values()) + [(None, "a b c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5):
        want = near_components(rows, width)
        got = hyperminhash.near_duplicates(docs, width=width).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_near_duplicates_at_other_thresholds(spark):
    rows = family_rows(7) + [(9001, "a b c d"), (9002, "a b c e"), (9003, "a b c"), (9004, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 80, 95, 100):
        got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs, width=2, percent=percent).collect()}
        assert got == near_components(rows, 2, percent), percent


def test_a_family_that_is_almost_alike(spark, monkeypatch):
    """Texts that meet in buckets without being linked make no pairs; the few links among them are found, in blocks too."""
    rng = random.Random(5)
    base = prose(rng, 150, 5000).split()
    rows = []
    for k in range(240):
        own = list(base)
        for at in rng.sample(range(len(own)), 12):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    rows += [(500 + k, rows[k][1].rsplit(" ", 1)[0] + " end") for k in range(0, 240, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = near_components(rows, 2)
    assert len(set(want.values())) > 200
    made = []
    real = hyperminhash._confirmed
    monkeypatch.setattr(hyperminhash, "_confirmed", lambda pairs, sets, percent: made.append(pairs.count()) or real(pairs, sets, percent))
    for members in (2000, 30):
        monkeypatch.setattr(hyperminhash, "BLOCK_MEMBERS", members)
        got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(docs, width=2).collect()}
        assert got == want
    # One leader for a member, not a pair for each meeting.
    assert max(made) <= len(rows)


def test_bands_follow_the_threshold():
    for percent in (50, 60, 80, 95):
        width = hyperminhash.band_rows(percent)
        assert (1 - (percent / 100) ** width) ** (hyperminhash.REGISTERS // width) <= hyperminhash.MISS
    assert [hyperminhash.alone(p) for p in (50, 75, 80, 90)] == [0, 2, 3, 8]


def test_recall_of_the_bands():
    """Sets at the threshold share a band: measured on drawn pairs."""
    rng = np.random.default_rng(12)
    width = hyperminhash.band_rows(80)
    missed = 0
    for _ in range(1500):
        n = int(rng.choice([20, 60, 200, 800]))
        both = rng.integers(0, 2**63, 8 * n, dtype=np.uint64) * np.uint64(2)
        one = np.unique(np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)]))
        two = np.unique(np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)]))
        keys = hyperminhash.band_keys(np.stack([hyperminhash.registers(one), hyperminhash.registers(two)]), width)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_keep_one(spark):
    docs = awkward(spark)
    out = hyperminhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.collect())
    want = near_components([(r[0], r[1]) for r in awkward_rows()], 5)
    assert {i for i in ids if i is not None} == {i for i, c in want.items() if i == c}
    assert ids.pop(None) == 2 and set(ids.values()) == {1}
    assert hyperminhash.keep_one(empty(spark)).count() == 0


def test_near_dedup_drops_tables_after_their_last_reader(spark, monkeypatch):
    """Registers and sets are the bulk of the disk: two such tables at a time, and none when the verdicts are there."""
    real, made, most = hyperminhash.written, [], []

    def held():
        paths = [(t, spark._jvm.org.apache.hadoop.fs.Path(t.written_to)) for t in made if {"registers", "set"} & set(t.columns)]
        return [t for t, p in paths if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]

    def noted(df, name):
        made.append(real(df, name))
        most.append(len(held()))
        return made[-1]

    monkeypatch.setattr(hyperminhash, "written", noted)
    rows = family_rows(3)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert max(most) == 2 and not held()
    assert {r.doc_id: r.component_id for r in got.collect()} == near_components(rows, 2)


def test_texts_are_not_shuffled_to_drop_a_few(spark):
    """A step that drops few rows joins their ids alone, so that Spark broadcasts these."""
    words = "concat_ws(' ', transform(sequence(1, 9), k -> sha2(concat(if(id < 6000, id, id - 6000), '-', k), 256)))"
    docs = spark.range(6300).selectExpr("id AS doc_id", f"{words} AS text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        for out, kept in ((hyperminhash.keep_one(docs), range(6000)), (exact_dedup.keep_unique(docs, exact_dedup.new_index(spark)), range(300, 6300))):
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keep_unique_where_rows_share_ids(spark):
    """An id loses the rows that do not stay, and one of two that are equal in id and text stays."""
    rows = [(1, "a"), (1, "b"), (2, "B"), (3, "c"), (3, "c"), (3, "d"), (None, "e"), (None, "e"), (None, "a"), (4, "D"), (5, None), (6, ""), (7, "f"), (7, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, exact_dedup.keep_unique(docs, exact_dedup.new_index(spark)).collect()))
    assert got == Counter([(1, "a"), (2, "B"), (3, "c"), (None, "e"), (4, "D"), (6, ""), (7, "f")])


def test_registers():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 9000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:7000], rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)]))
    one, two = hyperminhash.registers(a), hyperminhash.registers(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = hyperminhash.estimate(one, two, np.array(len(a)), np.array(len(b)))
    assert abs(got - true) < 0.1
    assert hyperminhash.worth_a_look(one[None], one[None], np.array([9000]), np.array([9000]), 0.8).all()
    assert not hyperminhash.worth_a_look(one[None], hyperminhash.registers(b[7000:])[None], np.array([9000]), np.array([2000]), 0.8).any()
    # A register holds the leading zeros of its smallest rest and the ten bits behind the leading one.
    for register in range(0, 512, 31):
        rest = min(int(x) & (2**55 - 1) for x in a if int(x) >> 55 == register) | 1
        assert int(one[register]) >> 10 == 55 - rest.bit_length()
        assert int(one[register]) & 1023 == (rest << 11 >> rest.bit_length() - 1 + 1) & 1023 if rest.bit_length() > 11 else True


def test_small_sets_borrow(spark):
    one = hyperminhash.registers(np.array([5, 2**60 + 3], dtype=np.uint64))
    assert len(set(one.tolist())) == 2 and len(one) == 512


def test_substring_dedup_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    want = removed_words(rows)
    got = phrase_automata.digests(awkward(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        words, gone = want[r.doc_id]
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept).hexdigest()), r.doc_id
    assert sum(sum(g) for _, g in want.values()) > 200
    assert phrase_automata.digests(empty(spark)).count() == 0


def test_substring_dedup_with_many_small_tasks(spark, monkeypatch):
    """Shards and tasks far smaller than the data give the same removals."""
    monkeypatch.setattr(phrase_automata, "SHARD_WINDOWS", 20)
    monkeypatch.setattr(phrase_automata, "TASK_PASSAGES", 5)
    rng = random.Random(9)
    shared = [prose(rng, n, 200) for n in (20, 21, 60)]
    rows = [(k, " ".join([prose(rng, rng.randrange(30), 200), rng.choice(shared), prose(rng, rng.randrange(30), 200)])) for k in range(60)]
    want = removed_words(rows)
    got = phrase_automata.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(g) for i, (_, g) in want.items()}


def test_windows_of_a_hot_anchor_are_dealt(spark, monkeypatch):
    rng = random.Random(12)
    lines = [prose(rng, 6, 5000) for _ in range(3000)]
    # The line with the smallest hash is the anchor of all windows around it.
    line = min(lines, key=lambda x: phrase_automata._runs(pd.util.hash_array(np.array(x.encode().split(), dtype=object)).astype(np.uint64), 6)[0])
    contexts = [" ".join([prose(rng, 14, 5000), line, prose(rng, 14, 5000)]) for _ in range(40)]
    rows = [(k, f"x{k} {c} y{k}") for k, c in enumerate(contexts * 2)]
    real = phrase_automata.locate

    def bounded(patterns, passages, window):
        assert sum(map(len, patterns.offsets)) <= 200
        return real(patterns, passages, window)

    monkeypatch.setattr(phrase_automata, "SHARD_WINDOWS", 100)
    monkeypatch.setattr(phrase_automata, "locate", bounded)
    want = removed_words(rows)
    got = phrase_automata.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(g) for i, (_, g) in want.items()}
    assert sum(r.n_removed for r in got) == 40 * 34


def test_remove_repeats(spark):
    rows = [(1, "a b  c"), (2, prose(random.Random(1), 40)), (3, prose(random.Random(1), 40)), (4, "x " + prose(random.Random(1), 40)), (5, None)]
    docs = spark.createDataFrame([(*r, *("y" for _ in range(len(SCHEMA.split(",")) - 2))) for r in rows], SCHEMA)
    out = {r.doc_id: r.text for r in phrase_automata.remove_repeats(docs).collect()}
    assert out == {1: "a b  c", 2: rows[1][1], 4: "x", 5: None}
    assert phrase_automata.remove_repeats(docs).columns == docs.columns
    assert phrase_automata.remove_repeats(empty(spark)).count() == 0


def test_locate_compares_words_not_hashes():
    words = " ".join(f"p{k}" for k in range(25))
    patterns = pd.DataFrame({"doc_id": [1], "first": [3], "offsets": [np.array([0, 2])], "words": [words]})
    passages = pd.DataFrame({"doc_id": [1, 2, 3], "first": [3, 0, 0], "words": [words, "q " + words, words.replace("p7", "r")]})
    found = phrase_automata.locate(patterns, passages)
    assert found.values.tolist() == [[2, 1, 1], [2, 3, 3]]


def test_rest_of_a_text_is_cut_once(spark):
    """A filter on what a Python function gives must not call it a second time, in a worker of its own."""
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 2, 40))) for k in range(6)], "doc_id long, text string")
    out = phrase_automata.remove_repeats(docs)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [(0, " ".join(f"w{j}" for j in range(40)))]
