"""Helpers shared by the per-series forecasting operators.

Forecasting joins per-series coefficient tables back to series rows.  With
no keys (one series) a join would have no condition; instead a constant
series key is added so every join stays an equi-join on keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C

SERIES = "__series"


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``(df, keys)`` with a constant ``__series`` key when ``keys`` is empty."""
    if keys:
        return df, list(keys)
    return df.withColumn(SERIES, F.lit(0)), [SERIES]


def unkeyed(df: DataFrame) -> DataFrame:
    return df.drop(SERIES) if SERIES in df.columns else df


def with_time_index(df: DataFrame, keys: Sequence[str], name: str = "t") -> DataFrame:
    """Days since the first ``ds`` of each series (the trend regressor)."""
    first = F.min(C.DS).over(Window.partitionBy(*keys))
    return df.withColumn("origin", first).withColumn(name, F.datediff(F.to_date(C.DS), F.to_date("origin")))


def r2(y: str, yhat: str):
    """Aggregate R^2 = 1 - SSE/SST; a constant target gives 1.0 for a perfect
    fit and 0.0 otherwise.  ``y`` must come with ``__ybar`` (group mean)."""
    err = F.col(y) - F.col(yhat)
    dev = F.col(y) - F.col("__ybar")
    sse = F.sum(err * err)
    sst = F.sum(dev * dev)
    return (
        F.when(sst > 0, F.lit(1.0) - sse / sst)
        .when(sse == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def error_metrics(df: DataFrame, group: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, RMSE and R^2 of ``yhat`` against ``y`` per ``group``."""
    with_mean = df.withColumn("__ybar", F.avg(y).over(Window.partitionBy(*group)))
    return with_mean.groupBy(*group).agg(
        F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"),
        F.sqrt(F.avg((F.col(y) - F.col(yhat)) * (F.col(y) - F.col(yhat)))).alias("rmse"),
        r2(y, yhat).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )
