"""Registered queries: resampling, series features and trend-season models."""

from __future__ import annotations

from revcast import columns as C
from revcast.operators import features as FT
from revcast.operators import periods as P
from revcast.operators import trend_season as TS
from revcast.oracle import half_up, oracle, partition, series_ctes, with_sales
from revcast.queries import monthly, query, rounded, sales
from revcast.session import materialize


def _k(keys) -> str:
    return "".join(f"{k}, " for k in keys)


def _on(keys, a, b) -> str:
    return " AND ".join([f"{a}.{k} = {b}.{k}" for k in keys]) or "TRUE"


# ---------------------------------------------------------------------------
# Resampling
# ---------------------------------------------------------------------------
SERIES_DIGITS = {C.REVENUE: 2, C.DISCOUNT: 8}
ROUNDED_SERIES = f"* REPLACE ({half_up('sales_revenue')} AS sales_revenue, ROUND(discount, 8) AS discount)"

RESAMPLE_CASES = {
    "resample_month": ("ME", [C.REGION, C.PRODUCT]),
    "resample_week": ("W", []),
    "resample_day": ("D", [C.REGION]),
}


def _register_resample(name, freq, keys):
    @query(name)
    def q(spark, sf_dir):
        return rounded(P.resample(sales(spark, sf_dir), freq, keys), SERIES_DIGITS)

    oracle(name, with_sales(*series_ctes(keys, freq)) + "SELECT " + ROUNDED_SERIES + " FROM series")


for _name, (_freq, _keys) in RESAMPLE_CASES.items():
    _register_resample(_name, _freq, _keys)


@query("sales_trend")
def q_sales_trend(spark, sf_dir):
    return rounded(P.sales_trend(sales(spark, sf_dir)), {C.REVENUE: 2})


oracle("sales_trend", with_sales(*series_ctes([], "ME")) + f"SELECT ds, {half_up('sales_revenue')} AS sales_revenue FROM series")


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------
def _features_sql(keys, source="series") -> str:
    part = partition(keys)
    w = f"OVER ({part}ORDER BY ds)"
    frame = f"OVER ({part}ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    lags = ", ".join(f"LAG(sales_revenue, {k}) {w} AS sales_lag_{k}" for k in C.DEFAULT_LAGS)
    return f"""feats AS (SELECT *, CAST(month(ds) AS INTEGER) AS month, CAST(year(ds) AS INTEGER) AS year, {lags},
       CASE WHEN COUNT(sales_revenue) {frame} = 3 THEN AVG(sales_revenue) {frame} END AS sales_rolling_mean_3,
       CASE WHEN COUNT(sales_revenue) {frame} = 3 THEN STDDEV_SAMP(sales_revenue) {frame} END AS sales_rolling_std_3
FROM {source})"""


ROLL_DIGITS = {FT.ROLL_MEAN: 2, FT.ROLL_STD: 2}
LAG_DIGITS = {FT.lag_name(k): 2 for k in C.DEFAULT_LAGS}
ROUNDED_LAGS = "".join(f"{half_up(c)} AS {c}, " for c in LAG_DIGITS)


@query("lag_features")
def q_lag_features(spark, sf_dir):
    keys = [C.REGION]
    feats = FT.regression_features(monthly(spark, sf_dir, keys), keys).dropna(how="any")
    return rounded(feats, ROLL_DIGITS | LAG_DIGITS | SERIES_DIGITS)


oracle(
    "lag_features",
    with_sales(*series_ctes([C.REGION]), _features_sql([C.REGION]))
    + f"""SELECT * REPLACE ({ROUNDED_LAGS}{half_up('sales_revenue')} AS sales_revenue, ROUND(discount, 8) AS discount,
                  ROUND(sales_rolling_mean_3, 2) AS sales_rolling_mean_3,
                  ROUND(sales_rolling_std_3, 2) AS sales_rolling_std_3)
FROM feats WHERE COLUMNS(*) IS NOT NULL""",
)


@query("rolling_features")
def q_rolling_features(spark, sf_dir):
    keys = [C.REGION, C.CATEGORY]
    feats = FT.regression_features(monthly(spark, sf_dir, keys), keys)
    return rounded(feats.select(*keys, C.DS, FT.ROLL_MEAN, FT.ROLL_STD), ROLL_DIGITS)


oracle(
    "rolling_features",
    with_sales(*series_ctes([C.REGION, C.CATEGORY]), _features_sql([C.REGION, C.CATEGORY]))
    + """SELECT region, product_category, ds, ROUND(sales_rolling_mean_3, 2) AS sales_rolling_mean_3,
       ROUND(sales_rolling_std_3, 2) AS sales_rolling_std_3 FROM feats""",
)


def _holdout_sql(keys, source, name="hs") -> str:
    part = partition(keys)
    return f"""{name}0 AS (SELECT *, COUNT(*) OVER ({part.strip() or ''}) AS n_rows,
       ROW_NUMBER() OVER ({part}ORDER BY ds DESC) AS __rn FROM {source}),
{name} AS (SELECT * EXCLUDE (__rn), GREATEST(1, LEAST(6, CAST(FLOOR(n_rows * 0.2) AS INTEGER))) AS test_size,
       CASE WHEN __rn <= GREATEST(1, LEAST(6, CAST(FLOOR(n_rows * 0.2) AS INTEGER))) THEN 'test' ELSE 'train' END AS split
FROM {name}0)"""


@query("holdout_split")
def q_holdout_split(spark, sf_dir):
    keys = [C.REGION]
    return rounded(FT.holdout_split(monthly(spark, sf_dir, keys), keys), SERIES_DIGITS)


oracle("holdout_split", with_sales(*series_ctes([C.REGION]), _holdout_sql([C.REGION], "series")) + f"SELECT {ROUNDED_SERIES} FROM hs")


@query("history_status")
def q_history_status(spark, sf_dir):
    keys = [C.REGION, C.PRODUCT]
    return FT.history_status(monthly(spark, sf_dir, keys), keys)


oracle(
    "history_status",
    with_sales(*series_ctes([C.REGION, C.PRODUCT]), _features_sql([C.REGION, C.PRODUCT]))
    + """, agg AS (SELECT region, product, COUNT(*) AS n_periods,
       CAST(SUM(CASE WHEN {complete} THEN 1 ELSE 0 END) AS BIGINT) AS n_feature_rows FROM feats GROUP BY ALL)
SELECT *, CASE WHEN n_periods < 15 THEN 'insufficient_history' WHEN n_feature_rows < 6 THEN 'insufficient_features'
       ELSE 'ok' END AS status FROM agg""".replace(
        "{complete}",
        " AND ".join(
            f"{c} IS NOT NULL"
            for c in ["sales_revenue", "units_sold", "discount"]
            + [f"sales_lag_{k}" for k in C.DEFAULT_LAGS]
            + ["sales_rolling_mean_3", "sales_rolling_std_3"]
        ),
    ),
)


# ---------------------------------------------------------------------------
# Linear trend and detrending
# ---------------------------------------------------------------------------
def _trend_sql(keys, source="series") -> list[str]:
    part = partition(keys)
    g = ("GROUP BY " + ", ".join(keys)) if keys else ""
    return [
        f"ti AS (SELECT *, MIN(ds) OVER ({part.strip()}) AS origin FROM {source})",
        f"ti2 AS (SELECT *, date_diff('day', origin, ds) AS t FROM ti)",
        _holdout_sql(keys, "ti2", "tsplit"),
        f"""coef AS (SELECT {_k(keys)}MIN(origin) AS origin, REGR_SLOPE(sales_revenue, t) AS slope,
       REGR_INTERCEPT(sales_revenue, t) AS intercept, COUNT(*) AS n_fit FROM tsplit WHERE split = 'train' {g})""",
    ]


@query("linear_trend")
def q_linear_trend(spark, sf_dir):
    keys = [C.REGION]
    return rounded(TS.linear_trend(monthly(spark, sf_dir, keys), keys), {"slope": 6, "intercept": 2})


oracle(
    "linear_trend",
    with_sales(*series_ctes([C.REGION]), *_trend_sql([C.REGION]))
    + "SELECT region, origin, ROUND(slope, 6) AS slope, ROUND(intercept, 2) AS intercept, n_fit FROM coef",
)


@query("detrend")
def q_detrend(spark, sf_dir):
    keys = [C.REGION]
    return rounded(TS.detrend(monthly(spark, sf_dir, keys), keys), {"trend": 2, "detrended": 2} | SERIES_DIGITS)


oracle(
    "detrend",
    with_sales(*series_ctes([C.REGION]), *_trend_sql([C.REGION]))
    + f"""SELECT s.* REPLACE ({half_up('s.sales_revenue')} AS sales_revenue, ROUND(s.discount, 8) AS discount),
       CAST(date_diff('day', c.origin, s.ds) AS INTEGER) AS t,
       ROUND(c.intercept + c.slope * date_diff('day', c.origin, s.ds), 2) AS trend,
       ROUND(s.sales_revenue - (c.intercept + c.slope * date_diff('day', c.origin, s.ds)), 2) AS detrended
FROM series s JOIN coef c USING (region)""",
)


# ---------------------------------------------------------------------------
# Trend + month effects
# ---------------------------------------------------------------------------
def _fit_sql(keys, source, p="f") -> list[str]:
    """CTEs ``{p}fit`` = (keys, month, month_effect, slope, origin, resid_std, n_obs)
    from ``source`` (keys, ds, y)."""
    part = partition(keys)
    kc = _k(keys)
    g = ("GROUP BY " + ", ".join(keys)) if keys else ""
    using_k = ", ".join(keys)
    jk = f"USING ({using_k})" if keys else "ON TRUE"
    jkm = f"USING ({using_k + ', ' if keys else ''}month)"
    return [
        f"""{p}0 AS (SELECT {kc}ds, y, MIN(ds) OVER ({part.strip()}) AS origin FROM {source})""",
        f"""{p}1 AS (SELECT *, date_diff('day', origin, ds) AS t, CAST(month(ds) AS INTEGER) AS month FROM {p}0)""",
        f"""{p}ms AS (SELECT {kc}month, AVG(t) AS tbar, AVG(y) AS ybar FROM {p}1 GROUP BY {kc}month)""",
        f"""{p}sl AS (SELECT {kc}SUM((t - tbar) * (y - ybar)) / NULLIF(SUM((t - tbar) * (t - tbar)), 0) AS slope,
       MIN(origin) AS origin, COUNT(*) AS n_obs FROM {p}1 JOIN {p}ms {jkm} {g})""",
        f"""{p}ef AS (SELECT {kc}month, ybar - slope * tbar AS month_effect FROM {p}ms JOIN {p}sl {jk})""",
        f"""{p}rs AS (SELECT {kc}CASE WHEN COUNT(*) > 1 THEN STDDEV_POP(y - (month_effect + slope * t)) ELSE 1.0 END
       AS resid_std FROM {p}1 JOIN {p}ef {jkm} JOIN (SELECT {kc}slope FROM {p}sl) {jk} {g})""",
        f"""{p}base AS (SELECT {kc}arg_min(month_effect, month) AS base FROM {p}ef {g})""",
        f"""{p}m12 AS (SELECT {kc}slope, origin, n_obs, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM {p}sl)""",
        f"""{p}fit AS (SELECT {''.join(f'm.{k}, ' for k in keys)}m.month, COALESCE(e.month_effect, b.base) AS month_effect,
       m.slope, m.origin, r.resid_std, m.n_obs
FROM {p}m12 m LEFT JOIN {p}ef e ON {_on(keys, 'm', 'e')} AND m.month = e.month
JOIN {p}base b ON {_on(keys, 'm', 'b')} JOIN {p}rs r ON {_on(keys, 'm', 'r')})""",
    ]


def _predict_sql(keys, frame, fit) -> str:
    """SELECT body predicting ``frame`` (keys, ds, ...) with ``fit``."""
    on = _on(keys, "x", "f")
    return f"""SELECT x.*, f.month_effect + f.slope * date_diff('day', f.origin, x.ds) AS yhat,
       f.month_effect + f.slope * date_diff('day', f.origin, x.ds) - 1.96 * f.resid_std AS yhat_lower,
       f.month_effect + f.slope * date_diff('day', f.origin, x.ds) + 1.96 * f.resid_std AS yhat_upper
FROM {frame} x JOIN {fit} f ON {on} AND CAST(month(x.ds) AS INTEGER) = f.month"""


FIT_DIGITS = {"month_effect": 2, "slope": 6, "resid_std": 2}
PRED_DIGITS = {"yhat": 2, "yhat_lower": 2, "yhat_upper": 2}
TS_KEYS = [C.REGION]


def _y_cte(keys, name="ys") -> str:
    return f"{name} AS (SELECT {_k(keys)}ds, sales_revenue AS y FROM series)"


@query("trend_season_fit")
def q_trend_season_fit(spark, sf_dir):
    return rounded(TS.trend_season_fit(monthly(spark, sf_dir, TS_KEYS), TS_KEYS), FIT_DIGITS)


oracle(
    "trend_season_fit",
    with_sales(*series_ctes(TS_KEYS), _y_cte(TS_KEYS), *_fit_sql(TS_KEYS, "ys"))
    + """SELECT region, month, ROUND(month_effect, 2) AS month_effect, ROUND(slope, 6) AS slope, origin,
       ROUND(resid_std, 2) AS resid_std, n_obs FROM ffit""",
)

PREDICT_KEYS = [C.REGION, C.CATEGORY]


@query("trend_season_predict")
def q_trend_season_predict(spark, sf_dir):
    series = materialize(monthly(spark, sf_dir, PREDICT_KEYS))
    fit = TS.trend_season_fit(series, PREDICT_KEYS)
    frame = series.select(*PREDICT_KEYS, C.DS, C.REVENUE)
    return rounded(TS.trend_season_predict(frame, fit, PREDICT_KEYS), PRED_DIGITS | {C.REVENUE: 2})


oracle(
    "trend_season_predict",
    with_sales(*series_ctes(PREDICT_KEYS), _y_cte(PREDICT_KEYS), *_fit_sql(PREDICT_KEYS, "ys"),
               "fr AS (SELECT region, product_category, ds, sales_revenue FROM series)",
               "pr AS (" + _predict_sql(PREDICT_KEYS, "fr", "ffit") + ")")
    + f"""SELECT * REPLACE ({half_up('sales_revenue')} AS sales_revenue, ROUND(yhat, 2) AS yhat,
                   ROUND(yhat_lower, 2) AS yhat_lower, ROUND(yhat_upper, 2) AS yhat_upper) FROM pr""",
)

HORIZON = 6


def _future_sql(keys, h, source="series", freq="ME") -> str:
    g = ("GROUP BY " + ", ".join(keys)) if keys else ""
    if freq == "ME":
        nxt = "CAST(last_day(CAST(last AS DATE) + to_months(CAST(step AS INTEGER))) AS TIMESTAMP)"
    else:
        days = 7 if freq == "W" else 1
        nxt = f"CAST(CAST(last AS DATE) + to_days(CAST({days} * step AS INTEGER)) AS TIMESTAMP)"
    return f"""fut AS (SELECT {_k(keys)}CAST(step AS INTEGER) AS step, {nxt} AS ds
FROM (SELECT {_k(keys)}MAX(ds) AS last FROM {source} {g}), (SELECT unnest(range(1, {h} + 1)) AS step))"""


@query("future_calendar")
def q_future_calendar(spark, sf_dir):
    return TS.future_calendar(monthly(spark, sf_dir, TS_KEYS), 12, TS_KEYS)


oracle("future_calendar", with_sales(*series_ctes(TS_KEYS), _future_sql(TS_KEYS, 12)) + "SELECT * FROM fut")


def _forecast_sql(keys, h, freq="ME") -> list[str]:
    kc = _k(keys)
    return [
        *series_ctes(keys, freq),
        _y_cte(keys),
        *_fit_sql(keys, "ys"),
        _future_sql(keys, h, freq=freq),
        f"""frame AS (SELECT {kc}ds, FALSE AS is_future FROM series
                  UNION ALL SELECT {kc}ds, TRUE AS is_future FROM fut)""",
        "fc AS (" + _predict_sql(keys, "frame", "ffit") + ")",
    ]


@query("trend_season_forecast")
def q_trend_season_forecast(spark, sf_dir):
    return rounded(TS.trend_season_forecast(monthly(spark, sf_dir, TS_KEYS), HORIZON, TS_KEYS), PRED_DIGITS)


oracle(
    "trend_season_forecast",
    with_sales(*_forecast_sql(TS_KEYS, HORIZON))
    + """SELECT region, ds, ROUND(yhat, 2) AS yhat, ROUND(yhat_lower, 2) AS yhat_lower,
       ROUND(yhat_upper, 2) AS yhat_upper, is_future FROM fc""",
)


WEEKLY_HORIZON = 4


@query("trend_season_forecast_weekly")
def q_trend_season_forecast_weekly(spark, sf_dir):
    """Weekly series, 4 weeks ahead (the horizon steps follow the frequency)."""
    series = monthly(spark, sf_dir, [], freq="W")
    return rounded(TS.trend_season_forecast(series, WEEKLY_HORIZON, [], freq="W"), PRED_DIGITS)


oracle(
    "trend_season_forecast_weekly",
    with_sales(*_forecast_sql([], WEEKLY_HORIZON, "W"))
    + """SELECT ds, ROUND(yhat, 2) AS yhat, ROUND(yhat_lower, 2) AS yhat_lower,
       ROUND(yhat_upper, 2) AS yhat_upper, is_future FROM fc""",
)


@query("forecast_overlay")
def q_forecast_overlay(spark, sf_dir):
    series = materialize(monthly(spark, sf_dir, TS_KEYS))
    fc = TS.trend_season_forecast(series, HORIZON, TS_KEYS)
    return rounded(TS.forecast_overlay(series, fc, TS_KEYS), PRED_DIGITS)


oracle(
    "forecast_overlay",
    with_sales(*_forecast_sql(TS_KEYS, HORIZON), "lst AS (SELECT region, MAX(ds) AS last, arg_max(sales_revenue, ds) AS v FROM series GROUP BY region)")
    + f"""SELECT region, last AS ds, {half_up('v')} AS yhat, {half_up('v')} AS yhat_lower, {half_up('v')} AS yhat_upper FROM lst
UNION ALL
SELECT fc.region, fc.ds, ROUND(yhat, 2), ROUND(yhat_lower, 2), ROUND(yhat_upper, 2)
FROM fc JOIN lst USING (region) WHERE fc.ds > lst.last""",
)


@query("future_only")
def q_future_only(spark, sf_dir):
    series = materialize(monthly(spark, sf_dir, TS_KEYS))
    fc = TS.trend_season_forecast(series, HORIZON, TS_KEYS)
    return rounded(TS.future_only(fc, series, TS_KEYS), PRED_DIGITS)


oracle(
    "future_only",
    with_sales(*_forecast_sql(TS_KEYS, HORIZON), "lst AS (SELECT region, MAX(ds) AS last FROM series GROUP BY region)")
    + """SELECT fc.region, fc.ds, ROUND(yhat, 2) AS yhat, ROUND(yhat_lower, 2) AS yhat_lower,
       ROUND(yhat_upper, 2) AS yhat_upper, is_future
FROM fc JOIN lst USING (region) WHERE fc.ds > lst.last""",
)


def _backtest_sql(keys) -> list[str]:
    kc = _k(keys)
    return [
        *series_ctes(keys),
        _y_cte(keys),
        _holdout_sql(keys, "ys", "bs"),
        f"tr AS (SELECT {kc}ds, y FROM bs WHERE split = 'train')",
        *_fit_sql(keys, "tr"),
        f"bsx AS (SELECT {kc}ds, y, split FROM bs)",
        "bt AS (" + _predict_sql(keys, "bsx", "ffit") + ")",
    ]


def _metrics_sql(keys, source, group_extra="") -> str:
    gcols = keys + ([group_extra] if group_extra else [])
    part = partition(gcols)
    g = ", ".join(gcols)
    return f"""mm0 AS (SELECT *, AVG(y) OVER ({part.strip()}) AS ybar FROM {source}),
mm AS (SELECT {g}, AVG(ABS(y - yhat)) AS mae, SQRT(AVG((y - yhat) * (y - yhat))) AS rmse,
       CASE WHEN SUM((y - ybar) * (y - ybar)) > 0 THEN 1.0 - SUM((y - yhat) * (y - yhat)) / SUM((y - ybar) * (y - ybar))
            WHEN SUM((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END AS r2, COUNT(*) AS n
FROM mm0 GROUP BY {g})"""


@query("backtest_metrics")
def q_backtest_metrics(spark, sf_dir):
    m = TS.backtest_metrics(monthly(spark, sf_dir, TS_KEYS), TS_KEYS)
    return rounded(m, {"mae": 2, "rmse": 2, "r2": 6})


oracle(
    "backtest_metrics",
    with_sales(*_backtest_sql(TS_KEYS), "bt_test AS (SELECT * FROM bt WHERE split = 'test')", _metrics_sql(TS_KEYS, "bt_test"))
    + "SELECT region, ROUND(mae, 2) AS mae, ROUND(rmse, 2) AS rmse, ROUND(r2, 6) AS r2, n FROM mm",
)


@query("overfit_report_trend_season")
def q_overfit_report_trend_season(spark, sf_dir):
    digits = {"train_r2": 4, "test_r2": 4, "train_mae": 2, "test_mae": 2, "overfit_gap": 4}
    return rounded(TS.overfit_report(monthly(spark, sf_dir, TS_KEYS), TS_KEYS), digits)


oracle(
    "overfit_report_trend_season",
    with_sales(*_backtest_sql(TS_KEYS), _metrics_sql(TS_KEYS, "bt", "split"))
    + """, wide AS (SELECT region,
       MAX(CASE WHEN split = 'train' THEN r2 END) AS train_r2, MAX(CASE WHEN split = 'test' THEN r2 END) AS test_r2,
       MAX(CASE WHEN split = 'train' THEN mae END) AS train_mae, MAX(CASE WHEN split = 'test' THEN mae END) AS test_mae
FROM mm GROUP BY region)
SELECT region, 'Trend-Season (Prophet fallback)' AS model, ROUND(train_r2, 4) AS train_r2, ROUND(test_r2, 4) AS test_r2,
       ROUND(train_mae, 2) AS train_mae, ROUND(test_mae, 2) AS test_mae, ROUND(train_r2 - test_r2, 4) AS overfit_gap
FROM wide""",
)
