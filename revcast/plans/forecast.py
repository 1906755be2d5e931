"""Forecast request: resample -> guard -> model -> future rows.

``forecast`` dispatches by model name (the form choice of the modelled
dashboard) and validates the horizon (1-12 periods, the form's limit; the
models themselves take any).  ``trend_season``
(the Prophet stand-in the application falls back to) has no holdout
metrics; the regression models return per-series MAE/RMSE/R^2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.operators import ml_forecast as ML
from revcast.operators import trend_season as TS
from revcast.operators.features import history_status
from revcast.operators.periods import resample
from revcast.operators.series import keyed, unkeyed
from revcast.session import materialize
from revcast.sources.files import forecast_export, forecast_file_name, write_forecast_csv

MODEL_ALIASES = {
    "trend_season": "trend_season",
    "prophet": "trend_season",
    "prophet / time series": "trend_season",
    "rf": "rf",
    "random forest regressor": "rf",
    "gbt": "gbt",
    "xgb": "gbt",
    "xgboost regressor": "gbt",
}
TREND_SEASON_NAME = "Regression-Trend Seasonal (Prophet Fallback)"


class ForecastResult:
    def __init__(self, forecast: DataFrame, metrics: DataFrame | None, model_name: str, status: DataFrame):
        self.forecast = forecast
        self.metrics = metrics
        self.model_name = model_name
        self.status = status

    def future(self) -> DataFrame:
        return self.forecast.filter(F.col("is_future"))

    def export(self) -> DataFrame:
        return forecast_export(self.future().drop("is_future"))

    def write_csv(self, folder: str) -> str:
        path = f"{folder.rstrip('/')}/{forecast_file_name(self.model_name)}"
        return write_forecast_csv(self.future().drop("is_future"), path)


def forecast(
    series: DataFrame,
    model: str = "trend_season",
    horizon: int = 6,
    keys: Sequence[str] = (),
    freq: str = "ME",
) -> ForecastResult:
    """Forecast every series of a resampled frame that passes the history guard."""
    code = MODEL_ALIASES.get(model.lower())
    if code is None:
        raise ValueError(f"Unknown model {model!r}")
    if not 1 <= int(horizon) <= C.MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {C.MAX_HORIZON}")
    # The series is written once; guard, fit and forecast read that.
    s, k = keyed(materialize(series), keys)
    status_of = materialize(history_status(s, k))
    status = unkeyed(status_of)
    if code == "trend_season":
        ok = status_of.filter(F.col("n_periods") >= C.MIN_HISTORY_PERIODS).select(*k)
        eligible = unkeyed(s.join(ok, on=k, how="left_semi"))
        fc = TS.trend_season_forecast(eligible, horizon, keys, freq=freq)
        return ForecastResult(fc, None, TREND_SEASON_NAME, status)
    result = ML.train_regression_model(unkeyed(s), horizon, code, keys, freq=freq)
    return ForecastResult(result.forecast, result.metrics, result.model_name, status)


def forecast_sales(
    sales: DataFrame, model: str = "trend_season", horizon: int = 6, keys: Sequence[str] = (), freq: str = "ME"
) -> ForecastResult:
    """Resample transactions, then ``forecast``."""
    return forecast(resample(sales, freq, keys), model, horizon, keys, freq)
