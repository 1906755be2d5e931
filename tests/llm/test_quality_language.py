"""Quality rules and language ID."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import regex
import zstandard
from pyspark.sql import functions as F

from revcast.llm import quality_rules, zstd_language
from tests.llm.helpers import awkward, awkward_rows, empty, prose

SF = "/root/testdata/sf0.01"


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_stats_equal_plain_counts():
    rng = random.Random(2)
    texts = [r[1] for r in awkward_rows() if r[0] != 16] + [prose(rng, n, v) for n in (1, 2, 3, 4, 50) for v in (1, 2, 9)]
    for t in texts:
        assert quality_rules.rule_stats(t)[:5] == plain_stats(t), (t or "")[:60]


def test_verdicts_awkward_rows(spark):
    rows = quality_rules.verdicts(awkward(spark), None).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((r[0], plain_stats(r[1])[0]) for r in awkward_rows())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.verdicts(empty(spark), None).count() == 0
    assert quality_rules.keep_good(awkward(spark), None).columns == awkward(spark).columns


def test_forest_separates_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.fit(docs.filter("doc_id % 2 = 0"), labels)
    held = quality_rules.verdicts(docs.filter("doc_id % 2 = 1"), forest).filter("NOT base_failed").join(labels, "doc_id")
    got = {(r.quality, r.kept): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) <= 0.02 * got[1, True]
    assert got.get((0, False), 0) >= 0.6 * sum(n for (q, _), n in got.items() if q == 0)
    kept = quality_rules.keep_good(docs, forest)
    assert kept.count() == quality_rules.verdicts(docs, forest).filter("kept").count()


def test_labels_that_say_nothing(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(docs, none) is None and quality_rules.fit(docs, odd) is None
    one = spark.createDataFrame([(7, 1, 0), (16, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.keep_good(docs, quality_rules.fit(docs, one)).filter("doc_id = 7").count() == 1


def test_many_label_rows_of_few_documents(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat(concat('word', id, ' here '), 30) AS text")
    labels = spark.range(200).crossJoin(spark.range(5000).toDF("k")).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert len(quality_rules.labelled_sample(docs, labels)) == 200
    assert len(quality_rules.labelled_sample(docs, labels, limit=60)) == 60


def test_every_labelled_document_counts(spark, monkeypatch):
    """Box, leaf counts and threshold change with one document, wherever it stands among those read."""
    monkeypatch.setattr(quality_rules, "MAX_LABELLED", 50)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60 + id % 40), k -> concat('w', (id + 1) * k))) AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    rows = quality_rules.labelled(docs, labels).toPandas()
    assert len(rows) == 400
    forest, local = quality_rules.fit(docs, labels), quality_rules.grow_forest(quality_rules.rates(rows), quality_rules.rates(rows))
    for a, b in zip(forest.path + forest.cut, local.path + local.cut, strict=True):
        assert np.allclose(a, b)
    assert forest.threshold == max(forest.score(quality_rules.rates(rows)))
    for odd in (3, 77, 200, 399):  # whichever it is, the longest document widens the box
        wide = docs.withColumn("text", F.when(F.col("doc_id") == odd, F.expr("concat_ws(' ', transform(sequence(1, 3000), k -> concat('v', k)))")).otherwise(F.col("text")))
        assert any(len(a) != len(b) or not np.allclose(a, b) for a, b in zip(quality_rules.fit(wide, labels).cut, forest.cut, strict=True))


def plain_path(forest, k: int, row) -> float:
    """Path length of one row in one tree, node by node."""
    at = 0
    while forest.feature[k][at] >= 0:
        at = forest.child[k][at] + int(row[forest.feature[k][at]] >= forest.cut[k][at])
    return forest.path[k][at]


def test_verdicts_equal_walks_through_the_trees(spark):
    """The score of a document is 2 ** -(mean path / expected path); it is kept if that is within the threshold."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality_rules.fit(docs, labels)
    rows = quality_rules.verdicts(docs, forest).toPandas().sample(150, random_state=3)
    for s, x in zip(rows.itertuples(), quality_rules.rates(rows), strict=True):
        mean = sum(plain_path(forest, k, x) for k in range(len(forest.feature))) / len(forest.feature)
        harmonic = sum(1 / k for k in range(1, forest.rows))
        want = 2 ** (-mean / (2 * harmonic - 2 * (forest.rows - 1) / forest.rows))
        assert abs(s.anomaly - want) < 2e-3 and s.kept == (not s.base_failed and s.anomaly <= forest.threshold)


def test_expected_path_and_scores():
    assert quality_rules.expected_path(np.array([0, 1, 2])).tolist() == [0, 0, 1]
    rng = np.random.default_rng(1)
    good = rng.normal(0, 0.1, (400, 3))
    odd = np.array([[5.0, 0, 0]])
    forest = quality_rules.grow_forest(good, np.vstack([good, odd]))
    assert forest.score(odd)[0] > np.quantile(forest.score(good), 0.999)


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = zstd_language.held_out()
    learned = zstd_language.train(docs.filter(~out))
    held = docs.filter(out)
    got = zstd_language.predict(held, learned).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == held.count() and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    sure = [r for r in got if r.confident]
    assert len(sure) > 0.8 * len(got) and sum(r.lang == r.lang_pred for r in sure) >= 0.98 * len(sure)
    for r in docs.select("doc_id", out.alias("h")).limit(50).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_copies_do_not_thin_out_a_dictionary(spark):
    rows = [(k, f"{w} " * 9 + f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}", w) for w, n in (("viele", 40), ("many", 500)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copied = docs.filter("lang = 'viele'").crossJoin(spark.range(2000)).drop("id").unionByName(docs.filter("lang = 'many'"))
    # The same texts teach the same, whatever their copies; the language with most rows comes first.
    learned, plain = (zstd_language.train(d, dict_docs=10) for d in (copied, docs))
    assert learned == plain and list(learned) == ["viele", "many"] and list(plain) == ["many", "viele"]
    assert all(text.count(b"\n") == 10 for text in learned.values())


def test_choice_equals_compression_by_hand(spark):
    """The language whose dictionary gives the smallest frame; equal sizes go to the language with most rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = zstd_language.train(docs.filter(~zstd_language.held_out()))
    assert all(len(d) <= zstd_language.DICT_BYTES + zstd_language.DICT_DOCS for d in learned.values())
    texts = {r.doc_id: r.text for r in docs.filter(zstd_language.held_out()).collect()}
    how = {"min_match": 4, "strategy": zstandard.STRATEGY_BTLAZY2, "write_content_size": 0, "write_checksum": 0}
    for r in zstd_language.predict(docs.filter(zstd_language.held_out()), learned).collect():
        raw = " ".join(regex.findall(r"\p{L}[\p{L}\p{Mn}\p{Mc}]*", (texts[r.doc_id] or "").lower())).encode()
        sizes = []
        for own in learned.values():
            content = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            level = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(own), **how)
            content.precompute_compress(compression_params=level)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=content, compression_params=level).compress(raw)))
        if raw:
            assert r.lang_pred == list(learned)[sizes.index(min(sizes))], r.doc_id
            assert abs(r.score - 1 / sum(2.0 ** (min(sizes) - s) for s in sizes)) < 1e-9
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_marks_stay_with_their_letters():
    assert zstd_language.letter_runs("हिन्दी भाषा 12 Cafe\u0301s!").decode() == "हिन्दी भाषा cafe\u0301s"
    assert zstd_language.letter_runs("\u0301 a_b 7x") == b"a b x"


def test_dictionaries_are_cut_in_the_tasks(spark):
    rows = [(k, f"{'abcdefghij'[k]} " * 50_000, "xx") for k in range(8)] + [(20, "kurz", "yy"), (21, "123", "zz")]
    learned = zstd_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dict_bytes=1000)
    assert len(learned["xx"]) == 1001 and learned["yy"] == b"kurz\n" and learned["zz"] == b"\n"


def test_language_awkward_rows(spark):
    learned = {"xx": b"one two three four five " * 40, "yy": b"eins zwei drei vier " * 40}
    docs = awkward(spark)
    rows = zstd_language.predict(docs, learned, keep=["lang"]).collect()
    assert len(rows) == docs.count() and rows[0].lang == "x"
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (1, 2, 3):
        assert by_id[i].lang_pred == "und" and by_id[i].score == 0
    assert all(r.lang_pred in learned for i, r in by_id.items() if i > 3)
    assert {r.lang_pred for r in zstd_language.predict(docs, {}).collect()} == {"und"}
    assert zstd_language.train(empty(spark)) == {} and zstd_language.predict(empty(spark), learned).count() == 0
    nulls = spark.createDataFrame([(1, "a b", None), (2, None, "en"), (3, "", "en")], "doc_id long, text string, lang string")
    assert zstd_language.train(nulls) == {}


def test_digits_and_signs_are_undetermined():
    classifier = zstd_language.Classifier({"en": b"the quick brown fox " * 30})
    assert classifier.classify("12 345 !!! ²")[0] == "und" and classifier.classify("fox 1")[0] == "en"
