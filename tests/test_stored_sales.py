"""The written layout, bucketed sources, the fact store and the lazy dashboard."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.operators import aggregates as A
from revcast.plans import dashboard as D
from revcast.plans.fact_store import FactStore
from revcast.sources import sales_layout as L
from revcast.sources.tables import sales_view
from tests.conftest import SMOKE_DIR


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_shuffles_neither_side(spark, monkeypatch):
    import revcast.sources.tables as T

    sources = L.bucket_sources(spark, SMOKE_DIR, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.sales_view_bucketed(spark, SMOKE_DIR, sources)
        text = plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange hashpartitioning" not in text
    assert sorted(map(str, out.collect())) == sorted(map(str, sales_view(spark, SMOKE_DIR).collect()))
    sources.drop(spark)
    assert not spark.catalog.tableExists(sources.lineitem)


def test_buckets_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(L, "table_bytes", lambda *_: 640 << 20)
    sources = L.bucket_sources(spark, SMOKE_DIR)
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {sources.lineitem}").collect()}
    assert int(facts["Num Buckets"]) == 40
    assert sorted(map(str, L.sales_view_bucketed(spark, SMOKE_DIR, sources).collect())) == sorted(map(str, sales_view(spark, SMOKE_DIR).collect()))
    sources.drop(spark)


def test_layout_reads_only_the_months_asked_for(spark):
    path = L.stored_sales(spark, SMOKE_DIR)
    whole = sales_view(spark, SMOKE_DIR)
    assert sorted(map(str, L.read_layout(spark, path).collect())) == sorted(map(str, whole.collect()))
    some = L.read_layout(spark, path, "1996-03-10", "1996-05-20")
    text = plan(some)
    assert "Join" not in text and "Exchange" not in text and "sale_month" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    want = whole.filter("date >= timestamp_ntz'1996-03-10' AND date < timestamp_ntz'1996-05-21'")
    assert some.count() == want.count() > 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "d string, region string, product_category string, product string, units_sold double, price_per_unit double, discount double, sales_revenue double").select(
        F.col("d").cast("timestamp_ntz").alias(C.DATE), "region", "product_category", "product", "units_sold", "price_per_unit", "discount", "sales_revenue"
    )


ONE = ("2024-01-05", "N", "a", "p", 1.0, 10.0, 0.1, 9.0)
TWO = ("2024-02-05", "S", "b", "q", 2.0, 5.0, None, 10.0)
THREE = (None, None, None, None, None, None, None, 1.5)


def test_facts_follow_the_files(spark, tmp_dir):
    folder = tmp_dir + "/in put"
    read = []

    def reader(files):
        read.append(files)
        return spark.read.parquet(*files)

    store = FactStore(spark, tmp_dir + "/store", folder, reader)
    with pytest.raises(ValueError):
        store.facts()
    frame(spark, [ONE, TWO]).coalesce(1).write.parquet(folder)
    assert len(store.refresh()) == 1 and store.refresh() == []
    frame(spark, [THREE]).coalesce(1).write.mode("append").parquet(folder)
    assert len(store.refresh()) == 1 and [len(f) for f in read] == [1, 1]

    def kpis():
        return A.kpi_summary_from(store.facts()).first(), A.kpi_summary(spark.read.parquet(folder)).first()

    got, want = kpis()
    assert got == want and got.row_count == 3 and got.total_revenue == 20.5
    # A file that changes counts as it is now, one that goes does not count.
    gone = [f for f in os.listdir(folder) if f.endswith(".parquet")]
    frame(spark, [TWO, TWO, THREE]).coalesce(1).write.mode("overwrite").parquet(folder)
    assert not set(gone) & set(os.listdir(folder)) and len(store.refresh()) == 1
    got, want = kpis()
    assert got == want and got.total_revenue == 21.5
    # A load that ran twice counts once; a file without rows is read once.
    from revcast.plans.fact_store import source_files

    store._load(source_files(spark, folder))
    assert kpis()[0] == want
    frame(spark, []).coalesce(1).write.mode("append").parquet(folder)
    assert len(store.refresh()) == 1 and store.refresh() == []
    assert kpis()[0] == want


def test_widgets_are_built_on_demand(spark, monkeypatch):
    df = sales_view(spark, SMOKE_DIR)
    built = []
    real = D.facts
    monkeypatch.setattr(D, "facts", lambda frame: built.append("facts") or real(frame))
    monkeypatch.setattr(D, "explorer_page", lambda frame: built.append("explorer") or frame.limit(1))
    monkeypatch.setattr(D, "price_volume_sample", lambda frame: built.append("sample") or frame.limit(1))
    widgets = D.dashboard(df, drilldown="PROMO")
    assert built == [] and set(widgets) >= {"kpis", "yoy", "trend", "region_map", "drilldown", "explorer"}
    assert widgets["kpis"].first().row_count == df.count()
    widgets["trend"]
    assert built == ["facts"]
    widgets["explorer"], widgets["explorer"]
    assert built == ["facts", "explorer"]
    with pytest.raises(KeyError):
        widgets["mystery"]


def test_every_widget_equals_its_operator(spark):
    from revcast.operators.allocation import region_country_allocation
    from revcast.operators.periods import sales_trend

    df = sales_view(spark, SMOKE_DIR).filter("region <> 'ASIA'")
    widgets = D.dashboard(df, drilldown="PROMO")
    want = {
        "kpis": A.kpi_summary(df), "yoy": A.yoy_growth(df), "trend": sales_trend(df), "region_map": region_country_allocation(df),
        "revenue_by_category": A.revenue_by_category(df), "category_share": A.category_share(df), "category_summary": A.category_summary(df),
        "drilldown": A.product_drilldown(df, "PROMO"),
    }

    def rows(frame):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in frame.select(*sorted(frame.columns)).collect())

    for name, frame in want.items():
        assert rows(widgets[name]) == rows(frame), name
