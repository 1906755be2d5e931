"""Every stage against a brute-force version of its decision, on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from revcast.llm import quality_rules
from revcast.llm.common import written
from tests.llm.helpers import CLASHING, awkward, empty, near_components, removed_words
from tests.llm.test_dedup import UPPER
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, SF), "stage")
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k == 0:
            stats = quality_rules.stats_frame([t for _, t in before])
            kept = quality_rules.judge(stats, forest).kept
            want = {i: t for (i, t), good in zip(before, kept, strict=True) if good}
        elif k == 1:
            last = {}
            for i, t in sorted(before):
                last[t.translate(UPPER)] = i
            want = {i: t for i, t in before if last[t.translate(UPPER)] == i}
        elif k == 2:
            component = near_components(before, 5)
            want = {i: t for i, t in before if component[i] == i}
        elif k == 3:
            want = {}
            for i, (words, gone) in removed_words(before).items():
                rest = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
                if not any(gone):
                    want[i] = dict(before)[i]
                elif rest:
                    want[i] = rest
        else:
            check_packing(docs.collect(), before, 2048)
            break
        assert after == want


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(out.columns) == {"doc_id", "text", *CLASHING}
        rows = out.count()
        assert rows == 0 if make is empty else rows > 0
