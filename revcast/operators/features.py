"""Lag, rolling and holdout features of periodic series (one row per period).

All windows are partitioned by the series keys and ordered by ``ds``; they
run on resampled series (series x periods rows), never on transactions, so
even a single-series window (no keys) holds one row per period.  Build them
on a gap-free series (``periods.resample``): lags count rows, not time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C

ROLL_MEAN = "sales_rolling_mean_3"
ROLL_STD = "sales_rolling_std_3"


def lag_name(k: int) -> str:
    return f"sales_lag_{k}"


def series_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(C.DS) if keys else Window.orderBy(C.DS)


def regression_features(
    series: DataFrame,
    keys: Sequence[str] = (),
    value: str = C.REVENUE,
    lags: Sequence[int] = tuple(C.DEFAULT_LAGS),
    window: int = C.ROLLING_WINDOW,
) -> DataFrame:
    """Add month, year, ``sales_lag_k`` and the mean / sample std of the
    previous ``window`` values (null unless all ``window`` are present)."""
    w = series_window(keys)
    frame = w.rowsBetween(-window, -1)
    present = F.count(value).over(frame)
    cols = {C.MONTH: F.month(C.DS), C.YEAR: F.year(C.DS)}
    for k in lags:
        cols[lag_name(k)] = F.lag(value, k).over(w)
    cols[ROLL_MEAN] = F.when(present == window, F.avg(value).over(frame))
    cols[ROLL_STD] = F.when(present == window, F.stddev_samp(value).over(frame))
    return series.withColumns(cols)


def feature_columns(df: DataFrame, with_year: bool = False) -> list[str]:
    """Lag and rolling columns, then month (and year for the lag regression)."""
    cols = [c for c in df.columns if c.startswith("sales_lag_") or c.startswith("sales_rolling_")]
    return cols + [C.MONTH] + ([C.YEAR] if with_year else [])


def holdout_size(n: Column) -> Column:
    """``max(1, min(6, int(0.2 * n)))`` rows held out at the end of a series."""
    return F.greatest(F.lit(1), F.least(F.lit(C.MAX_HOLDOUT), F.floor(n * C.HOLDOUT_FRACTION).cast("int")))


def holdout_split(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``n_rows``, ``test_size`` and ``split`` ('train' / 'test') per series."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    newest_first = (
        Window.partitionBy(*keys).orderBy(F.col(C.DS).desc()) if keys else Window.orderBy(F.col(C.DS).desc())
    )
    n = F.count(F.lit(1)).over(whole)
    out = series.withColumn("n_rows", n).withColumn("test_size", holdout_size(F.col("n_rows")))
    return out.withColumn(
        "split",
        F.when(F.row_number().over(newest_first) <= F.col("test_size"), F.lit("test")).otherwise(F.lit("train")),
    )


def history_status(
    series: DataFrame,
    keys: Sequence[str] = (),
    value: str = C.REVENUE,
    min_periods: int = C.MIN_HISTORY_PERIODS,
    min_clean: int = C.MIN_CLEAN_ROWS,
) -> DataFrame:
    """Per series: periods, complete feature rows and whether models may run.

    ``status`` is ``insufficient_history`` below ``min_periods`` periods,
    ``insufficient_features`` below ``min_clean`` complete feature rows,
    else ``ok`` - a row per series instead of an exception, so one short
    series does not stop the others.
    """
    feats = regression_features(series, keys, value)
    complete = F.lit(True)
    for c in feats.columns:
        complete = complete & F.col(c).isNotNull()
    agg = feats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.sum(complete.cast("int")).cast("bigint").alias("n_feature_rows"),
    )
    status = (
        F.when(F.col("n_periods") < min_periods, F.lit("insufficient_history"))
        .when(F.col("n_feature_rows") < min_clean, F.lit("insufficient_features"))
        .otherwise(F.lit("ok"))
    )
    return agg.withColumn("status", status)
