"""KPIs, report facts, allocation, bounded views and text functions."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions import text as TX
from revcast.operators import aggregates as A
from revcast.operators.allocation import region_country_allocation
from revcast.operators.sampling import explorer_page, price_volume_sample
from revcast.plans.report import report


@pytest.fixture
def report_frame(spark):
    rows = [
        (500000.0, "East", "Electronics", "Laptop Pro", 100.0, 100000.0),
        (300000.0, "West", "Furniture", "Ergo Chair", 150.0, 60000.0),
    ]
    return spark.createDataFrame(
        rows, "sales_revenue double, region string, product_category string, product string, units_sold double, total_profit double"
    )


def test_report_facts_from_reference_fixture(report_frame):
    facts = {(r["section"], r["item"]): r for r in report(report_frame, "executive").collect()}
    assert facts[("summary", "total_revenue")]["value"] == 800000.0
    assert facts[("summary", "total_profit")]["value"] == 160000.0
    assert facts[("summary", "margin_pct")]["value"] == pytest.approx(20.0)
    assert facts[("summary", "total_units")]["value"] == 250.0
    assert facts[("summary", "avg_order_value")]["value"] == 400000.0
    assert facts[("region", "East")]["pct"] == pytest.approx(62.5)
    assert facts[("top_products", "Laptop Pro")]["rank"] == 1
    sections = {r["section"] for r in report(report_frame, "regional").collect()}
    assert sections == {"summary", "region"}
    with pytest.raises(ValueError):
        report(report_frame, "weekly")


def test_report_without_profit_column_uses_fallback_margin(report_frame):
    k = A.report_kpis(report_frame.drop(C.PROFIT)).first()
    assert k["total_profit"] == pytest.approx(800000.0 * 0.2134)


def test_contributions_sum_to_100(report_frame):
    pct = sum(r["pct"] for r in A.region_contribution(report_frame).collect())
    assert pct == pytest.approx(100.0)


def test_kpis_and_yoy(spark):
    rows = [
        (dt.datetime(2022, 5, 1), 100.0, 1.0, 0.1),
        (dt.datetime(2023, 5, 1), 150.0, 2.0, 0.2),
        (dt.datetime(2023, 6, 1), 50.0, 3.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "date timestamp_ntz, sales_revenue double, units_sold double, discount double")
    k = A.kpi_summary(df).first()
    assert (k["total_revenue"], k["total_units"], k["row_count"]) == (300.0, 6.0, 3)
    assert k["avg_discount_pct"] == pytest.approx(10.0) and k["avg_order_value"] == 100.0
    y = A.yoy_growth(df).first()
    assert y["latest_year"] == 2023 and y["yoy_growth_pct"] == pytest.approx(100.0)
    assert y["yoy_label"] == "+100.0% YoY"
    single = A.yoy_growth(df.filter(F.year("date") == 2023)).first()
    assert single["yoy_growth_pct"] is None and single["yoy_label"].startswith("N/A")


def test_exact_money_sum_is_order_independent(spark):
    vals = [0.1] * 10 + [1e9, -1e9] + [0.01] * 7
    df = spark.createDataFrame([(v,) for v in vals], "sales_revenue double")
    a = df.repartition(7).agg(A.money_sum("sales_revenue")).first()[0]
    b = df.coalesce(1).agg(A.money_sum("sales_revenue")).first()[0]
    assert a == b == 1.07


def test_top_products_ties_and_limit(spark):
    rows = [(p, v) for p, v in [("b", 10.0), ("a", 10.0), ("c", 5.0), ("d", 1.0), ("e", 1.0), ("f", 0.5)]]
    df = spark.createDataFrame(rows, "product string, sales_revenue double")
    got = [(r["rank"], r["product"]) for r in A.top_products(df, 5).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_region_allocation_sums_to_region_total(spark):
    rows = [("North", 100.0), ("East", 50.0), ("Atlantis", 7.0)]
    df = spark.createDataFrame(rows, "region string, sales_revenue double")
    out = region_country_allocation(df).toPandas()
    assert out.groupby("region")["sales"].sum().round(6).to_dict() == {"Atlantis": 7.0, "East": 50.0, "North": 100.0}
    assert set(out[out.region == "Atlantis"].country) == {"USA"}
    assert set(out[out.region == "North"].country) == {"USA", "CAN"}


def test_explorer_page_and_sample(spark):
    df = spark.range(5000).select(
        F.col("id").cast("double").alias(C.UNITS),
        (F.col("id") * 2.0).alias(C.PRICE),
        F.lit(1.0).alias(C.REVENUE),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias(C.DATE),
    )
    page = explorer_page(df, n=10).collect()
    assert len(page) == 10 and page[0]["total_rows"] == 5000 and page[0][C.UNITS] == 0.0
    s1 = price_volume_sample(df).collect()
    s2 = price_volume_sample(df.repartition(5)).collect()
    assert len(s1) == 2000 and sorted(s1) == sorted(s2)
    assert price_volume_sample(df.limit(100)).count() == 100


def test_text_functions(spark):
    payload = [{"icon": "X", "text": " Revenue hit $1,234.5M today "}, {"text": "No icon"}, {"icon": "Y", "text": "  "},
               {"text": "c"}, {"text": "d"}, {"text": "e"}]
    responses = [
        ("```json\n" + json.dumps(payload) + "\n```",),
        ("not json at all",),
        ("  ```\n[]\n```  ",),
    ]
    df = spark.createDataFrame(responses, "r string")
    stripped = [r[0] for r in df.select(TX.strip_fences("r")).collect()]
    assert stripped[0].startswith("[") and stripped[0].endswith("]")
    assert stripped[2] == "[]"
    parsed = [r[0] for r in df.select(TX.parse_insights("r")).collect()]
    first = parsed[0]
    assert [i["icon"] for i in first] == ["X", C.DEFAULT_ICON, C.DEFAULT_ICON]  # blank dropped after first 4
    assert first[0]["text"] == "Revenue hit <b style='color:#00CC96;'>$1,234.5M</b> today"
    assert parsed[1] is None and parsed[2] == []
    assert TX.title_case("product_category") == "Product Category"


def test_dashboard_plan_widgets(spark):
    from revcast.plans.dashboard import apply_filters, dashboard, prepare

    rows = [
        ("2023-01-05", "Laptop", "Electronics", "North", 2, 1000.0, 0.1, 1800.0),
        ("2023-02-10", "Case", "Accessories", "East", 5, 20.0, 0.0, 100.0),
        ("2024-03-15", "Watch", "Wearables", "West", 1, 300.0, 0.0, 300.0),
    ]
    cols = ["order_date", "product_name", "category", "region", "quantity", "unit_price", "discount", "revenue"]
    df = prepare(spark.createDataFrame(rows, cols))
    assert C.YEAR in df.columns and C.PROFIT in df.columns
    filtered = apply_filters(df, "2023-01-01", "2023-12-31", {C.REGION: ["North", "East"]})
    widgets = dashboard(filtered, drilldown="Electronics")
    assert widgets["kpis"].first()["total_revenue"] == 1900.0
    assert widgets["yoy"].first()["yoy_label"].startswith("N/A")
    assert widgets["explorer"].count() == 2
    assert {r[C.PRODUCT] for r in widgets["drilldown"].collect()} == {"Laptop"}
    assert widgets["trend"].count() == 2
