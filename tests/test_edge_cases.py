"""Empty inputs and degenerate series."""

from __future__ import annotations

import datetime as dt

from revcast import columns as C
from revcast.functions.money import money_sum
from revcast.operators import aggregates as A
from revcast.operators import trend_season as TS
from revcast.operators.filters import filter_isin, is_empty
from revcast.operators.periods import resample
from revcast.plans.report import report

SALES = (
    "date timestamp_ntz, product_category string, product string, region string, units_sold double, "
    "price_per_unit double, discount double, sales_revenue double"
)


def test_empty_frame_kpis_and_report(spark):
    empty = spark.createDataFrame([], SALES)
    k = A.kpi_summary(empty).first()
    assert (k["total_revenue"], k["row_count"], k["avg_order_value"]) == (0.0, 0, 0.0)
    assert A.yoy_growth(empty).first()["yoy_label"].startswith("N/A")
    facts = {r["item"]: r["value"] for r in report(empty, "executive").collect() if r["section"] == "summary"}
    assert facts["total_revenue"] == 0.0 and facts["margin_pct"] == 0.0
    assert resample(empty, "ME", [C.REGION]).count() == 0
    assert is_empty(filter_isin(empty, {C.REGION: ["X"]}))


def test_null_keys_do_not_form_groups(spark):
    rows = [
        (dt.datetime(2024, 1, 1), None, "p", "N", 1.0, 5.0, 0.0, 5.0),
        (dt.datetime(2024, 1, 2), "A", "p", "N", 1.0, 7.0, 0.0, 7.0),
    ]
    df = spark.createDataFrame(rows, SALES)
    by_cat = {r[C.CATEGORY]: r[C.REVENUE] for r in A.revenue_by_category(df).collect()}
    assert by_cat == {"A": 7.0}
    share = A.category_share(df).collect()
    assert len(share) == 1 and share[0]["total_revenue"] == 12.0  # the total still counts every row


def test_unidentified_slope_gives_null_forecast(spark):
    # Twelve months, each seen once: the within-month slope is not identified.
    rows = [("A", dt.datetime(2023, m, 28), float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "region string, ds timestamp_ntz, sales_revenue double")
    fc = TS.trend_season_forecast(df, 2, [C.REGION]).collect()
    assert all(r["yhat"] is None for r in fc)


def test_money_sum_matches_decimal_arithmetic(spark):
    from decimal import Decimal

    from hypothesis import given, settings
    from hypothesis import strategies as st

    amounts = st.lists(st.integers(min_value=-10**9, max_value=10**9), min_size=1, max_size=40)

    @settings(max_examples=15, deadline=None)
    @given(amounts, st.integers(min_value=1, max_value=6))
    def check(cents, parts):
        # amounts with 4 decimals, like price x (1 - discount)
        values = [c / 10000 for c in cents]
        df = spark.createDataFrame([(v,) for v in values], "sales_revenue double").repartition(parts)
        got = df.agg(money_sum("sales_revenue")).first()[0]
        want = float(sum(Decimal(c) / Decimal(10000) for c in cents))
        assert abs(got - want) <= 1e-9 * max(1.0, abs(want)) and round(got, 6) == round(want, 6)

    check()
