"""Resampling labels and gap filling, lag/rolling features, holdout sizes."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest

from revcast import columns as C
from revcast.operators.features import history_status, holdout_split, regression_features
from revcast.operators.periods import resample

SCHEMA = "date timestamp_ntz, region string, units_sold double, discount double, sales_revenue double"


def _sales(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_weekly_labels_end_on_sunday(spark):
    rows = [
        (dt.datetime(2024, 1, 1), "N", 1.0, 0.1, 10.0),  # Monday -> 2024-01-07
        (dt.datetime(2024, 1, 7), "N", 1.0, 0.1, 5.0),  # Sunday labels itself
        (dt.datetime(2024, 1, 8), "N", 1.0, 0.1, 7.0),  # -> 2024-01-14
    ]
    out = {r[C.DS]: r[C.REVENUE] for r in resample(_sales(spark, rows), "W").collect()}
    assert out == {dt.datetime(2024, 1, 7): 15.0, dt.datetime(2024, 1, 14): 7.0}


def test_monthly_gap_is_filled_with_zero_and_null_discount(spark):
    rows = [
        (dt.datetime(2024, 1, 15), "N", 2.0, 0.1, 10.0),
        (dt.datetime(2024, 3, 2), "N", 1.0, 0.3, 4.0),
        (dt.datetime(2024, 3, 9), "N", 1.0, 0.1, 6.0),
        (dt.datetime(2024, 2, 1), "S", 1.0, 0.0, 1.0),
    ]
    out = resample(_sales(spark, rows), "ME", [C.REGION]).orderBy(C.REGION, C.DS).collect()
    north = [(r[C.DS], r[C.REVENUE], r[C.UNITS], r[C.DISCOUNT]) for r in out if r[C.REGION] == "N"]
    assert north[0] == (dt.datetime(2024, 1, 31), 10.0, 2.0, 0.1)
    assert north[1] == (dt.datetime(2024, 2, 29), 0.0, 0.0, None)
    assert north[2][0] == dt.datetime(2024, 3, 31) and north[2][1] == 10.0
    assert north[2][3] == pytest.approx(0.2)
    assert [r[C.DS] for r in out if r[C.REGION] == "S"] == [dt.datetime(2024, 2, 29)]


def test_daily_resample_and_null_keys_dropped(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 10), "N", 1.0, 0.0, 1.0),
        (dt.datetime(2024, 1, 3, 9), "N", 1.0, 0.0, 2.0),
        (dt.datetime(2024, 1, 2), None, 1.0, 0.0, 99.0),
    ]
    out = resample(_sales(spark, rows), "D", [C.REGION]).orderBy(C.DS).collect()
    assert [(r[C.DS].day, r[C.REVENUE]) for r in out] == [(1, 1.0), (2, 0.0), (3, 2.0)]


def _series(spark, values, key="A"):
    ends = pd.date_range("2020-01-31", periods=len(values), freq="ME")
    rows = [(key, ts.to_pydatetime(), float(v), 1.0, 0.1) for ts, v in zip(ends, values)]
    return spark.createDataFrame(rows, "region string, ds timestamp_ntz, sales_revenue double, units_sold double, discount double")


def test_lags_and_rolling_match_pandas_semantics(spark):
    values = [float(v) for v in range(1, 21)]
    out = regression_features(_series(spark, values), [C.REGION]).orderBy(C.DS).collect()
    r = out[12]
    assert r["sales_lag_1"] == values[11] and r["sales_lag_12"] == values[0]
    assert r["sales_rolling_mean_3"] == pytest.approx((values[9] + values[10] + values[11]) / 3)
    assert r["sales_rolling_std_3"] == pytest.approx(1.0)
    assert out[2]["sales_rolling_mean_3"] is None  # only two previous values
    assert out[3]["sales_rolling_mean_3"] == pytest.approx(2.0)
    assert out[11]["sales_lag_12"] is None


@pytest.mark.parametrize("n,expected", [(3, 1), (5, 1), (15, 3), (29, 5), (40, 6), (80, 6)])
def test_holdout_size(spark, n, expected):
    out = holdout_split(_series(spark, range(n)), [C.REGION])
    assert out.filter("split = 'test'").count() == expected
    newest = out.orderBy(C.DS).collect()[-1]
    assert newest["split"] == "test"


def test_history_status(spark):
    long = _series(spark, range(30), "A")
    short = _series(spark, range(10), "B")
    status = {r[C.REGION]: r["status"] for r in history_status(long.unionByName(short), [C.REGION]).collect()}
    assert status == {"A": "ok", "B": "insufficient_history"}


def test_no_nan_in_rolling_std_of_constant(spark):
    out = regression_features(_series(spark, [5.0] * 6), [C.REGION]).orderBy(C.DS).collect()
    assert out[4]["sales_rolling_std_3"] == 0.0
    assert not any(isinstance(r["sales_rolling_mean_3"], float) and math.isnan(r["sales_rolling_mean_3"]) for r in out)
