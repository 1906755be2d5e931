"""Files as people send them: dates, numbers, names, encodings, extremes, short series."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.coerce import date_order, to_double, to_timestamp_utc
from revcast.operators import aggregates as A
from revcast.operators import filters as FL
from revcast.operators import ml_forecast as ML
from revcast.operators.periods import resample
from revcast.operators.profit import calculate_profit
from revcast.plans import dashboard as D
from revcast.sources import files
from revcast.sources.mapping import map_and_clean, suggest_mappings, undated_rows
from tests.test_edge_cases import SALES
from tests.test_forecasting import _monthly, _seasonal

JAN5 = dt.datetime(2024, 1, 5)
DATES = [
    ("2024-01-05", JAN5), ("2024-01-05T10:30:00", JAN5.replace(hour=10, minute=30)), ("2024-01-05 10:30", JAN5.replace(hour=10, minute=30)),
    ("2024-01-05T01:00:00+02:00", dt.datetime(2024, 1, 4, 23)), ("2024/1/5", JAN5), ("2024.01.05", JAN5), ("20240105", JAN5),
    ("2024-1-5", JAN5), ("1/5/2024", JAN5), ("01-05-2024", JAN5), ("01/05/24", JAN5), ("1.5.2024 3:04 PM", JAN5.replace(hour=15, minute=4)),
    ("1/5/2024 12:00 am", JAN5), ("13/02/2024", dt.datetime(2024, 2, 13)), ("02/13/2024", dt.datetime(2024, 2, 13)),
    ("Jan 5, 2024", JAN5), ("January 5 2024", JAN5), ("5 January 2024", JAN5), ("05-Jan-2024", JAN5), ("5-jan-24", JAN5),
    ("Jan 5th, 2024 10:30:15", JAN5.replace(hour=10, minute=30, second=15)), ("5 Sept 1999", dt.datetime(1999, 9, 5)), ("1/5/69", dt.datetime(1969, 1, 5)),
    ("  2024-01-05 ", JAN5), ("2024", dt.datetime(2024, 1, 1)),
    ("soon", None), ("", None), (None, None), ("31/31/2024", None), ("2024-02-30", None), ("Foo 5, 2024", None), ("10:30", None), ("1/5/2024 99:99", None),
]


def test_dates_as_people_write_them(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(DATES)], "k int, when string")
    got = {r.k: r.at for r in df.select("k", to_timestamp_utc(df, "when").alias("at")).collect()}
    assert [got[k] for k in range(len(DATES))] == [want for _, want in DATES]


def test_the_column_decides_the_order(spark):
    texts = ["01-02-2024", "03/04/2024", "25.12.2024"]
    df = spark.createDataFrame([(t, 1.0) for t in texts], "date string, sales double")
    assert date_order(df, "date").first().asDict() == {"n_day_first": 1, "n_month_first": 0, "n_either": 2}
    days = sorted(r[C.DATE] for r in map_and_clean(df, "date", "sales").collect())
    assert days == [dt.datetime(2024, 2, 1), dt.datetime(2024, 4, 3), dt.datetime(2024, 12, 25)]
    month_first = df.limit(2)
    assert sorted(r[C.DATE] for r in map_and_clean(month_first, "date", "sales").collect())[0] == dt.datetime(2024, 1, 2)
    told = map_and_clean(df.filter("date <> '25.12.2024'"), "date", "sales", day_first=True)
    assert sorted(r[C.DATE] for r in told.collect())[0] == dt.datetime(2024, 2, 1)
    assert undated_rows(spark.createDataFrame([("x",), ("1/2/24",), (None,)], "d string"), "d").first().asDict() == {"n_rows": 3, "n_undated": 2}


def test_one_row_does_not_date_the_table_anew(spark):
    rows = [("01/02/2024", 1.0)] * 9 + [("01/25/2024", 1.0), ("25/01/2024", 1.0), ("2024-03-04", 1.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "date string, sales double")
    assert date_order(df, "date").first().asDict() == {"n_day_first": 1, "n_month_first": 1, "n_either": 9}
    days = sorted(r[C.DATE] for r in map_and_clean(df, "date", "sales").collect())
    assert days == [dt.datetime(2024, 1, 2)] * 9 + [dt.datetime(2024, 1, 25)] * 2 + [dt.datetime(2024, 3, 4)]
    only_day = df.filter("date <> '01/25/2024'")
    days = sorted(r[C.DATE] for r in map_and_clean(only_day, "date", "sales").collect())
    assert days == [dt.datetime(2024, 1, 25)] + [dt.datetime(2024, 2, 1)] * 9 + [dt.datetime(2024, 3, 4)]
    timed = spark.createDataFrame([("3/4/2024 10:30:15.5", 1.0, 40.0), ("13/4/2024", 1.0, 20.0)], "date string, sales double, discount double")
    got = {r[C.DATE]: r[C.DISCOUNT] for r in map_and_clean(timed, "date", "sales").collect()}
    assert got == {dt.datetime(2024, 4, 3, 10, 30, 15, 500000): 0.4, dt.datetime(2024, 4, 13): 0.2}


def test_the_source_is_read_once(spark):
    from pyspark.sql import Observation

    reads = Observation()
    df = spark.createDataFrame([("13/4/2024", 1.0, 40.0, "a b"), ("x", 1.0, 900.0, "c")], "date string, sales double, discount double, `odd (kg), x` string")
    out = map_and_clean(df.observe(reads, F.count(F.lit(1)).alias("n")), "date", "sales")
    assert reads.get["n"] == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" not in plan and "parquet" in plan.lower()
    assert out.first()["odd (kg), x"] == "a b" and out.first()[C.DISCOUNT] == 0.4


def test_numbers(spark):
    texts = ["1.5", " 2 ", "1e3", ".5", "-3.", "5d", "1f", "Infinity", "-inf", "NaN", "0x10", "", None, "1,000"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, n string")
    got = [r.v for r in df.select("k", to_double(df, "n", -1.0).alias("v")).orderBy("k").collect()]
    assert got == [1.5, 2.0, 1000.0, 0.5, -3.0] + [-1.0] * 9
    special = spark.createDataFrame([(float("inf"),), (float("nan"),), (float("-inf"),), (None,), (2.0,)], "n double")
    assert sorted(r.v for r in special.select(to_double(special, "n", 0.0).alias("v")).collect()) == [0.0, 0.0, 0.0, 0.0, 2.0]


def test_columns_that_collide(spark):
    df = spark.createDataFrame(
        [("2024-01-05", "old", "FR", "zone", 5.0, 9.0, "m", 1, 2)],
        "order_date string, Date string, Country string, REGION string, amount double, total_profit double, profit_margin string, extra int, year int",
    )
    out = map_and_clean(df, *suggest_mappings(df))
    assert [c.lower() for c in out.columns].count("region") == 1 and len({c.lower() for c in out.columns}) == len(out.columns)
    row = out.first()
    assert (row[C.REGION], row[C.REVENUE], row["extra"]) == ("FR", 5.0, 1)
    assert D.engineer_features(out).first()[C.YEAR] == 2024
    same = df.selectExpr("order_date", "amount", "extra as Note", "year as note")
    assert [c for c in map_and_clean(same, "order_date", "amount").columns if c.lower() == "note"] == ["Note"]


def test_suggestions_by_rank(spark):
    def suggest(schema):
        return suggest_mappings(spark.createDataFrame([], schema))

    assert suggest("a string, when_sold timestamp, b double") == ("when_sold", "b")
    assert suggest("sales double, period string") == ("period", "sales")
    assert suggest("date string, note string") == ("date", "note")
    assert suggest("note string, at date") == ("at", "note")
    assert suggest("y string") == ("y", "y")
    assert suggest("amount_old double, revenue_net double, date string") == ("date", "revenue_net")
    assert suggest_mappings(spark.createDataFrame([(1,)], "x int").drop("x")) == (None, None)


def test_lookup_refuses_two_values_for_a_key(spark):
    sales = spark.createDataFrame([("A", 10.0)], "product_category string, sales_revenue double")
    twice = spark.createDataFrame([("A", 0.1), ("A", 0.1), ("B", 0.2)], "key string, value double")
    assert calculate_profit(sales, twice).first()[C.PROFIT] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="2 values"):
        calculate_profit(sales, twice.union(spark.createDataFrame([("A", 0.9)], "key string, value double")))


def sale(day, revenue, category="A"):
    return (dt.datetime(2024, 1, day), category, "p", "N", 1.0, revenue, 0.0, revenue)


def test_small_and_huge_amounts(spark):
    df = spark.createDataFrame([sale(1, 0.001), sale(2, 0.002), sale(3, 1e-9)], SALES)
    assert A.kpi_summary(df).first()["total_revenue"] == pytest.approx(0.003000001, rel=1e-12)
    assert [r[C.REVENUE] for r in resample(df, "D").orderBy("ds").collect()] == pytest.approx([0.001, 0.002, 1e-9])
    huge = spark.createDataFrame([sale(1, 1e13), sale(2, 0.25), sale(3, -1e13), sale(4, 1e300), sale(5, -1e300)], SALES)
    assert A.kpi_summary(huge).first()["total_revenue"] == pytest.approx(0.25, abs=0.01)
    infinite = spark.createDataFrame([sale(1, float("inf")), sale(2, 1.0), sale(3, float("nan"))], SALES)
    assert A.kpi_summary(infinite).first()["total_revenue"] == float("inf")
    assert A.dataset_fingerprint(huge).count() == A.dataset_fingerprint(infinite).count() == 1


def test_booleans_are_categorical_everywhere(spark):
    df = spark.createDataFrame([(True, "x", 1, dt.date(2024, 1, 1), 1.5)], "promo boolean, s string, n int, d date, v double")
    listed = FL.categorical_columns(df)
    profile = {r.column_name for r in FL.categorical_profile(df).collect() if r.is_categorical}
    assert listed == ["promo", "s", "n", "d", "v"] and set(listed) == profile
    assert D.choose_column(df, "region") == "promo" and D.choose_column(df, "s") == "s"


def test_each_file_has_its_own_encoding(spark, tmp_path):
    for name, encoding, city in (("a", "utf-8", "Café \ufffd"), ("b", "latin-1", "Montréal"), ("c", "utf-8", "plain")):
        (tmp_path / f"{name}.csv").write_bytes(f"Date,City,Sales\n2024-01-01,{city},10.5\n".encode(encoding))
    df = files.load_sales(spark, str(tmp_path), fmt="csv")
    assert {r.City for r in df.collect()} == {"Café \ufffd", "Montréal", "plain"}
    utf8, latin = files.files_not_utf8(spark, str(tmp_path))
    assert [os.path.basename(p) for p in latin] == ["b.csv"] and len(utf8) == 2


def test_overfit_report_on_short_series(spark):
    """16 months leave four complete feature rows; 13 leave one, 5 none."""
    series = _monthly(spark, _seasonal(16, 1), "A").unionByName(_monthly(spark, _seasonal(13, 2), "B")).unionByName(_monthly(spark, _seasonal(5, 3), "C"))
    report = ML.ml_overfit_report(series, [C.REGION], models=("lr", "rf")).toPandas().set_index(["region", "model"])
    assert len(report) == 6 and set(report.loc["A"].status) == {"ok"}
    assert report.loc["A"].train_mae.notna().all() and report.loc[["B", "C"]].train_mae.isna().all()
    assert set(report.loc["B"].status) == set(report.loc["C"].status) == {"insufficient_features"}
    assert ML.ml_overfit_report(series.filter("region = 'C'"), [C.REGION], models=("lr",)).count() == 1


def test_no_eligible_series_is_no_error(spark):
    res = ML.train_regression_model(_monthly(spark, _seasonal(6, 3)), 3, "rf", [C.REGION])
    assert res.forecast.count() == 0 and res.metrics.count() == 0
    assert [r.status for r in res.status.collect()] == ["insufficient_history"]


def test_scale_does_not_see_the_holdout(spark):
    """Changing the held-out values leaves the features and labels of the training rows alone."""
    y = _seasonal(30, 4)
    wild = np.concatenate([y[:-6], y[-6:] * 50])
    tables = [
        ML.Backtests(_monthly(spark, v), [C.REGION])._table("detrended").filter("ds < '2023-01-01'").orderBy("ds").select("ds", "label", "scale").collect()
        for v in (y, wild)
    ]
    # 24 periods before the six that the trend and the scale must not see.
    assert tables[0] == tables[1] and len(tables[0]) > 5


def test_forest_does_not_depend_on_partitions(spark):
    series = _monthly(spark, _seasonal(30, 5), "A").unionByName(_monthly(spark, _seasonal(34, 6), "B"))
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            fc = ML.train_regression_model(series.repartition(n), 3, "rf", [C.REGION]).forecast
            found.append(fc.filter("is_future").orderBy("region", "ds").toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pd.testing.assert_frame_equal(*found, rtol=1e-9)


def test_dashboard_widgets_equal_those_of_the_rows(spark):
    rows = [sale(d, float(d), c) for d, c in ((1, "A"), (2, "A"), (3, "B"), (4, None))]
    df = spark.createDataFrame(rows + [(dt.datetime(2023, 5, 1), "A", "q", "S", 2.0, 4.0, 0.1, 7.2)], SALES)
    out = D.dashboard(df, drilldown="A")
    for name, direct in (
        ("kpis", A.kpi_summary(df)), ("yoy", A.yoy_growth(df)), ("revenue_by_category", A.revenue_by_category(df)),
        ("category_share", A.category_share(df)), ("category_summary", A.category_summary(df)), ("drilldown", A.product_drilldown(df, "A")),
    ):
        a, b = (x.orderBy(*x.columns).toPandas() for x in (out[name], direct))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert out["trend"].count() == 9 and out["explorer"].count() == 5 and out["price_volume"].count() == 5
    chosen = D.apply_filters(df, selections={C.REGION: ["S"]})
    assert D.dashboard(chosen)["kpis"].first()["row_count"] == 1
    assert chosen.filter(F.lit(False)).count() == 0
