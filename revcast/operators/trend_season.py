"""Linear trend and trend-plus-month-effect models, fitted in closed form.

The month-effect model is OLS of ``y`` on an intercept, the day index ``t``
and month dummies.  With a free effect per month the OLS slope is the
within-month slope (Frisch-Waugh-Lovell)::

    k   = sum (t - tbar_m)(y - ybar_m) / sum (t - tbar_m)^2
    a_m = ybar_m - k * tbar_m            yhat = a_m + k * t

so a fit needs no solver: per-month means and the pooled slope are window
aggregates over the rows of each series, computed after one exchange by the
series key, and any number of series fit in the same job.  A month absent from the fitted rows
takes the effect of the lowest fitted month (what an all-zero dummy column
gives).  The interval is yhat +- 1.96 x the population std of the in-sample
residuals (1.0 with a single row).  When every month is seen once the slope
is not identified; such a series gets a null slope and null forecasts.

All frames here are series-sized (series x periods); fit tables (12 rows per
series) are joined back on the series keys and month, and AQE broadcasts them
while they are small.
The series a fit reads several times is checkpointed first
(``session.materialize``), so the sales aggregation behind it runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.periods import normalise_freq, step_periods
from revcast.operators.features import holdout_split
from revcast.operators.series import error_metrics, keyed, unkeyed, with_time_index
from revcast.session import materialize

MONTH_EFFECT = "month_effect"


def _prepared(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return series.select(*keys, C.DS, F.col(value).cast("double").alias("y"))


# ---------------------------------------------------------------------------
# Linear trend (y ~ a + b t)
# ---------------------------------------------------------------------------
def linear_trend(
    series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE, holdout: bool = True
) -> DataFrame:
    """Per series: origin (first ds), slope and intercept of revenue on the day
    index, fitted on the training part (all rows but the holdout) or on all
    rows when ``holdout=False``."""
    df, k = keyed(_prepared(series, keys, value), keys)
    df = with_time_index(df, k)
    if holdout:
        df = holdout_split(df, k).filter(F.col("split") == "train")
    coef = df.groupBy(*k).agg(
        F.min("origin").alias("origin"),
        F.regr_slope("y", "t").alias("slope"),
        F.regr_intercept("y", "t").alias("intercept"),
        F.count(F.lit(1)).alias("n_fit"),
    )
    return unkeyed(coef)


def detrend(
    series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE, holdout: bool = True
) -> DataFrame:
    """Series with ``t``, ``trend`` and ``detrended`` = value - trend, using the
    trend fitted by ``linear_trend`` (on the training part by default)."""
    series = materialize(series)
    df, k = keyed(series, keys)
    coef, _ = keyed(linear_trend(series, keys, value, holdout), keys)
    joined = df.join(coef.drop("n_fit"), on=k)
    t = F.datediff(F.to_date(C.DS), F.to_date("origin"))
    out = joined.withColumn("t", t).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))
    out = out.withColumn("detrended", F.col(value) - F.col("trend"))
    return unkeyed(out.drop("origin", "slope", "intercept"))


# ---------------------------------------------------------------------------
# Trend + month effects
# ---------------------------------------------------------------------------
def _fit(prepared: DataFrame, k: list[str]) -> DataFrame:
    """Fit table (k..., month 1..12, month_effect, slope, origin, resid_std, n_obs).

    One exchange by series key; everything after it runs on that
    partitioning: (series, month) windows and aggregates are clustered by
    it already, so means, slope, residual spread and the 12-month table need
    no further shuffle.
    """
    series = Window.partitionBy(*k)
    by_month = Window.partitionBy(*k, C.MONTH)
    df = with_time_index(prepared, k).withColumn(C.MONTH, F.month(C.DS))
    df = df.withColumn("tbar", F.avg("t").over(by_month)).withColumn("ybar", F.avg("y").over(by_month))
    dt = F.col("t") - F.col("tbar")
    dy = F.col("y") - F.col("ybar")
    df = df.withColumn("slope", F.try_divide(F.sum(dt * dy).over(series), F.sum(dt * dt).over(series)))
    df = df.withColumn(MONTH_EFFECT, F.col("ybar") - F.col("slope") * F.col("tbar"))
    resid = F.col("y") - (F.col(MONTH_EFFECT) + F.col("slope") * F.col("t"))
    df = df.withColumn("__rstd", F.stddev_pop(resid).over(series))
    per_month = df.groupBy(*k, C.MONTH).agg(
        F.first(MONTH_EFFECT).alias(MONTH_EFFECT),
        F.first("slope").alias("slope"),
        F.first("__rstd").alias("__rstd"),
        F.min("origin").alias("origin"),
        F.count(F.lit(1)).alias("__n"),
    )
    per_series = per_month.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.struct(C.MONTH, MONTH_EFFECT))).alias("__effects"),
        F.min_by(MONTH_EFFECT, C.MONTH).alias("__base"),
        F.first("slope").alias("slope"),
        F.first("__rstd").alias("__rstd"),
        F.min("origin").alias("origin"),
        F.sum("__n").alias("n_obs"),
    )
    resid_std = F.when(F.col("n_obs") > 1, F.col("__rstd")).otherwise(F.lit(1.0))
    table = per_series.select(
        *k, "slope", "origin", "n_obs", "__effects", "__base", resid_std.alias("resid_std"),
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias(C.MONTH),
    ).withColumn(MONTH_EFFECT, F.coalesce(F.try_element_at("__effects", F.col(C.MONTH)), F.col("__base")))
    return table.select(*k, C.MONTH, MONTH_EFFECT, "slope", "origin", "resid_std", "n_obs")


def trend_season_fit(series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """Fit on every row of each series; one row per (series, month)."""
    prepared, k = keyed(_prepared(series, keys, value), keys)
    return unkeyed(_fit(materialize(prepared), k))


def _predict(frame: DataFrame, fit: DataFrame, k: list[str]) -> DataFrame:
    joined = frame.withColumn(C.MONTH, F.month(C.DS)).join(fit, on=[*k, C.MONTH])
    yhat = F.col(MONTH_EFFECT) + F.col("slope") * F.datediff(F.to_date(C.DS), F.to_date("origin"))
    band = F.lit(C.INTERVAL_Z) * F.col("resid_std")
    return (
        joined.withColumn("yhat", yhat)
        .withColumn("yhat_lower", F.col("yhat") - band)
        .withColumn("yhat_upper", F.col("yhat") + band)
        .drop(C.MONTH, MONTH_EFFECT, "slope", "origin", "resid_std", "n_obs")
    )


def trend_season_predict(frame: DataFrame, fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``frame`` (keys..., ds, ...) with yhat and the 95 % band from ``fit``."""
    f, k = keyed(frame, keys)
    ft, _ = keyed(fit, keys)
    return unkeyed(_predict(f, ft, k))


def future_calendar(
    series: DataFrame, horizon: int, keys: Sequence[str] = (), freq: str = "ME"
) -> DataFrame:
    """The ``horizon`` period labels after each series' last ``ds``."""
    if int(horizon) < 1:
        raise ValueError("horizon must be at least 1")
    freq = normalise_freq(freq)
    last = series.groupBy(*keys).agg(F.max(C.DS).alias("__last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(int(horizon))))
    return last.select(*keys, "__last", steps.alias("step")).select(
        *keys, "step", step_periods("__last", F.col("step"), freq).alias(C.DS)
    )


def trend_season_forecast(
    series: DataFrame,
    horizon: int = 6,
    keys: Sequence[str] = (),
    value: str = C.REVENUE,
    freq: str = "ME",
) -> DataFrame:
    """Fitted values for the history plus ``horizon`` future periods:
    ``(keys..., ds, yhat, yhat_lower, yhat_upper, is_future)``."""
    prepared, k = keyed(_prepared(series, keys, value), keys)
    prepared = materialize(prepared)
    fit = _fit(prepared, k)
    history = prepared.select(*k, C.DS, F.lit(False).alias("is_future"))
    future = future_calendar(prepared, horizon, k, freq).select(*k, C.DS, F.lit(True).alias("is_future"))
    out = _predict(history.unionByName(future), fit, k)
    return unkeyed(out.select(*k, C.DS, "yhat", "yhat_lower", "yhat_upper", "is_future"))


def trend_season_backtest(series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """Fit on the training part, predict every row; rows carry ``split``."""
    prepared, k = keyed(_prepared(series, keys, value), keys)
    split = materialize(holdout_split(prepared, k).select(*k, C.DS, "y", "split"))
    fit = _fit(split.filter(F.col("split") == "train").select(*k, C.DS, "y"), k)
    return unkeyed(_predict(split, fit, k))


def backtest_metrics(series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """MAE, RMSE and R^2 of the trend-season model on each series' holdout."""
    bt, k = keyed(trend_season_backtest(series, keys, value), keys)
    m = error_metrics(bt.filter(F.col("split") == "test"), k)
    return unkeyed(m)


def overfit_report(series: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """Train/test R^2 and MAE of the trend-season model, and the R^2 gap."""
    bt, k = keyed(trend_season_backtest(series, keys, value), keys)
    return unkeyed(overfit_table(bt, k, "Trend-Season (Prophet fallback)"))


def overfit_table(pred: DataFrame, k: list[str], model: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Pivot per-split metrics into the overfit report row of one model."""
    m = error_metrics(pred, [*k, "split"], y, yhat)
    wide = m.groupBy(*k).agg(
        F.max(F.when(F.col("split") == "train", F.col("r2"))).alias("train_r2"),
        F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("test_r2"),
        F.max(F.when(F.col("split") == "train", F.col("mae"))).alias("train_mae"),
        F.max(F.when(F.col("split") == "test", F.col("mae"))).alias("test_mae"),
    )
    return wide.select(
        *k,
        F.lit(model).alias("model"),
        "train_r2",
        "test_r2",
        "train_mae",
        "test_mae",
        (F.col("train_r2") - F.col("test_r2")).alias("overfit_gap"),
    )


def forecast_overlay(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = (), value: str = C.REVENUE) -> DataFrame:
    """Future forecast rows preceded by the last actual row of each series
    (yhat = bounds = actual), so a chart line joins history to forecast."""
    h, k = keyed(history, keys)
    f, _ = keyed(forecast, keys)
    last = h.groupBy(*k).agg(F.max_by(F.col(value), F.col(C.DS)).alias("__v"), F.max(C.DS).alias("__last"))
    bridge = last.select(
        *k,
        F.col("__last").alias(C.DS),
        F.col("__v").alias("yhat"),
        F.col("__v").alias("yhat_lower"),
        F.col("__v").alias("yhat_upper"),
    )
    future = f.join(last.select(*k, "__last"), on=k).filter(F.col(C.DS) > F.col("__last"))
    future = future.select(*k, C.DS, "yhat", "yhat_lower", "yhat_upper")
    return unkeyed(bridge.unionByName(future))


def future_only(forecast: DataFrame, history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forecast rows strictly after each series' last historical ``ds``."""
    h, k = keyed(history, keys)
    f, _ = keyed(forecast, keys)
    last = h.groupBy(*k).agg(F.max(C.DS).alias("__last"))
    return unkeyed(f.join(last, on=k).filter(F.col(C.DS) > F.col("__last")).drop("__last"))
