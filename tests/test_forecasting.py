"""Trend-season closed form vs a least-squares solve; forecast properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from revcast import columns as C
from revcast.operators import ml_forecast as ML
from revcast.operators import trend_season as TS
from revcast.plans.forecast import forecast


def _monthly(spark, values, key="A", start="2021-01-31"):
    ends = pd.date_range(start, periods=len(values), freq="ME")
    rows = [(key, ts.to_pydatetime(), float(v), 1.0, 0.1) for ts, v in zip(ends, values)]
    return spark.createDataFrame(rows, "region string, ds timestamp_ntz, sales_revenue double, units_sold double, discount double")


def _seasonal(n, seed=0, level=5000.0, slope=40.0, noise=50.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return level + slope * t + 800 * np.sin(2 * np.pi * t / 12) + rng.normal(0, noise, n)


def _lstsq_fit(ds: pd.DatetimeIndex, y: np.ndarray):
    """OLS with intercept, day index and month dummies (drop the first month)."""
    t = (ds - ds.min()).days.to_numpy(dtype=float)
    months = ds.month.to_numpy()
    X = [np.ones_like(t), t] + [(months == m).astype(float) for m in range(2, 13)]
    X = np.column_stack(X)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    fitted = X @ beta
    return beta, fitted, np.std(y - fitted)


def test_trend_season_matches_least_squares(spark):
    y = _seasonal(40)
    series = _monthly(spark, y)
    fc = TS.trend_season_forecast(series, horizon=6, keys=[C.REGION]).orderBy(C.DS).toPandas()
    ds = pd.date_range("2021-01-31", periods=40, freq="ME")
    beta, fitted, std = _lstsq_fit(ds, y)
    hist = fc[~fc["is_future"]]
    np.testing.assert_allclose(hist["yhat"].to_numpy(), fitted, rtol=1e-9, atol=1e-6)
    np.testing.assert_allclose((hist["yhat_upper"] - hist["yhat"]).to_numpy(), 1.96 * std, rtol=1e-9)
    future = fc[fc["is_future"]]
    assert len(future) == 6
    fds = pd.DatetimeIndex(future["ds"])
    assert list(fds) == list(pd.date_range(ds[-1], periods=7, freq="ME")[1:])
    t = (fds - ds.min()).days.to_numpy(dtype=float)
    dummies = np.column_stack([(fds.month == m).astype(float) for m in range(2, 13)])
    expected = beta[0] + beta[1] * t + dummies @ beta[2:]
    np.testing.assert_allclose(future["yhat"].to_numpy(), expected, rtol=1e-9)


def test_unseen_month_uses_lowest_fitted_month(spark):
    # Only Mar..Oct observed over three years -> months 1, 2, 11, 12 unseen.
    rows = []
    for year in (2020, 2021, 2022):
        for m in range(3, 11):
            rows.append(("A", pd.Timestamp(year=year, month=m, day=1) + pd.offsets.MonthEnd(0), float(100 * m + year)))
    df = spark.createDataFrame(
        [(k, ts.to_pydatetime(), v) for k, ts, v in rows], "region string, ds timestamp_ntz, sales_revenue double"
    )
    fit = {r[C.MONTH]: r[TS.MONTH_EFFECT] for r in TS.trend_season_fit(df, [C.REGION]).collect()}
    assert fit[1] == pytest.approx(fit[3]) and fit[12] == pytest.approx(fit[3])
    assert fit[4] != pytest.approx(fit[3])


def test_trend_season_many_series_and_no_keys(spark):
    a = _monthly(spark, _seasonal(30, 1), "A")
    b = _monthly(spark, _seasonal(24, 2, level=100.0), "B")
    fc = TS.trend_season_forecast(a.unionByName(b), 3, [C.REGION]).toPandas()
    assert fc.groupby("region").size().to_dict() == {"A": 33, "B": 27}
    assert (fc["yhat_lower"] <= fc["yhat"]).all() and (fc["yhat"] <= fc["yhat_upper"]).all()
    single = TS.trend_season_forecast(a.drop(C.REGION), 2)
    assert single.columns == ["ds", "yhat", "yhat_lower", "yhat_upper", "is_future"]
    assert single.count() == 32


def test_linear_trend_and_metrics(spark):
    y = 1000.0 + 10.0 * np.arange(20)
    series = _monthly(spark, y)
    coef = TS.linear_trend(series, [C.REGION], holdout=False).first()
    ds = pd.date_range("2021-01-31", periods=20, freq="ME")
    t = (ds - ds.min()).days.to_numpy(dtype=float)
    slope, intercept = np.polyfit(t, y, 1)
    assert coef["slope"] == pytest.approx(slope) and coef["intercept"] == pytest.approx(intercept)
    m = TS.backtest_metrics(series, [C.REGION]).first()
    assert m["n"] == 4 and m["mae"] >= 0 and m["rmse"] >= m["mae"] - 1e-9


def test_horizon_validation(spark):
    series = _monthly(spark, _seasonal(20))
    # Only the form's dispatch has an upper limit.
    assert TS.future_calendar(series, 30, [C.REGION]).count() == 30
    for horizon in (0, 13):
        with pytest.raises(ValueError):
            forecast(series, "trend_season", horizon, [C.REGION])
    with pytest.raises(ValueError):
        TS.future_calendar(series, 0, [C.REGION])
    with pytest.raises(ValueError):
        forecast(series, "mystery", 3, [C.REGION])


@pytest.mark.parametrize("model", ["rf", "gbt"])
def test_regression_forecast_properties(spark, model):
    a = _monthly(spark, _seasonal(30, 3), "A")
    b = _monthly(spark, _seasonal(36, 4, level=20000.0, slope=-5.0), "B")
    short = _monthly(spark, _seasonal(10, 5), "C")
    series = a.unionByName(b).unionByName(short)
    res = ML.train_regression_model(series, horizon=4, model=model, keys=[C.REGION])
    fc = res.forecast.toPandas()
    sizes = fc.groupby("region").size().to_dict()
    assert sizes == {"A": 34, "B": 40}  # history + horizon; short series left out
    fut = fc[fc["is_future"]]
    assert (fut["yhat"] >= 0).all() and (fut["yhat_lower"] >= 0).all()
    assert (fut["yhat_lower"] <= fut["yhat"]).all() and (fut["yhat"] <= fut["yhat_upper"]).all()
    hist = fc[~fc["is_future"]]
    assert (hist["yhat"] == hist["yhat_lower"]).all()
    metrics = res.metrics.toPandas()
    assert set(metrics["region"]) == {"A", "B"}
    assert {"mae", "rmse", "r2"} <= set(metrics.columns)


def test_single_series_regression_and_overfit_report(spark):
    series = _monthly(spark, _seasonal(42, 6)).drop(C.REGION)
    res = ML.train_regression_model(series, horizon=6, model="rf")
    assert res.forecast.count() == 48
    report = ML.ml_overfit_report(series, models=("lr", "rf")).toPandas()
    assert list(report["model"]) == ["Linear Regression", "Random Forest (Detrended & Regularized)"]
    lr = report.iloc[0]
    assert lr["train_r2"] > 0.5  # clean seasonal series is well explained
    assert lr["overfit_gap"] == pytest.approx(round(lr["train_r2"] - lr["test_r2"], 4), abs=1e-4)


def test_lag_regression_matches_least_squares(spark):
    y = _seasonal(36, 7)
    series = _monthly(spark, y)
    pred = ML.lag_regression_backtest(series, [C.REGION]).orderBy(C.DS).toPandas()
    # Brute-force reference: build the same features in pandas and solve OLS.
    ds = pd.date_range("2021-01-31", periods=36, freq="ME")
    f = pd.DataFrame({"y": y, "month": ds.month, "year": ds.year})
    for k in (1, 2, 3, 12):
        f[f"lag_{k}"] = f["y"].shift(k)
    f["roll_mean"] = f["y"].shift(1).rolling(3).mean()
    f["roll_std"] = f["y"].shift(1).rolling(3).std()
    f = f.dropna().reset_index(drop=True)
    cols = ["lag_1", "lag_2", "lag_3", "lag_12", "roll_mean", "roll_std", "month", "year"]
    n_test = max(1, min(6, int(len(f) * 0.2)))
    train = f.iloc[:-n_test]
    X = np.column_stack([np.ones(len(train))] + [train[c].to_numpy(float) for c in cols])
    beta, *_ = np.linalg.lstsq(X, train["y"].to_numpy(), rcond=None)
    Xall = np.column_stack([np.ones(len(f))] + [f[c].to_numpy(float) for c in cols])
    assert len(pred) == len(f)
    assert (pred["split"] == "test").sum() == n_test
    np.testing.assert_allclose(pred["yhat"].to_numpy(), Xall @ beta, rtol=1e-6, atol=1e-3)
