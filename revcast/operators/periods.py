"""Resample transactions to gap-free periodic series (daily, weekly, monthly).

Plan: one hash aggregation of the transactions by ``(keys, period)`` (partial
aggregation per task, so hot keys only add rows to an already-combined
partial), then gap filling on the aggregate: each period row looks at the
next present period of its series (``lead``) and emits the empty periods in
between (``sequence`` + ``explode``).  The transactions are scanned once;
everything after the first aggregation works on series-sized data (series x
periods).  Empty periods get revenue 0 and units 0 and a null mean
discount, like a pandas resample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.money import money_sum
from revcast.functions.periods import normalise_freq, period_end, periods_between, step_periods

_SUM = "__revenue"


def aggregate_periods(df: DataFrame, freq: str = "ME", keys: Sequence[str] = (), date_col: str = C.DATE) -> DataFrame:
    """Per ``(keys, ds)``: revenue sum, units sum, mean discount (no spine)."""
    keys = list(keys)
    valid = F.col(date_col).isNotNull()
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    labelled = df.filter(valid).withColumn(C.DS, period_end(date_col, freq))
    return labelled.groupBy(*keys, C.DS).agg(
        money_sum(C.REVENUE).alias(_SUM),
        F.sum(C.UNITS).alias(C.UNITS),
        F.avg(C.DISCOUNT).alias(C.DISCOUNT),
    )


def resample(
    df: DataFrame,
    freq: str = "ME",
    keys: Sequence[str] = (),
    date_col: str = C.DATE,
    fill_gaps: bool = True,
) -> DataFrame:
    """Series frame ``(keys..., ds, sales_revenue, units_sold, discount)``."""
    freq = normalise_freq(freq)
    keys = list(keys)
    agg = aggregate_periods(df, freq, keys, date_col)
    if fill_gaps:
        agg = fill_gaps_after(agg, keys, freq)
    return agg.select(
        *keys,
        C.DS,
        F.coalesce(F.col(_SUM), F.lit(0.0)).alias(C.REVENUE),
        F.coalesce(F.col(C.UNITS), F.lit(0.0)).cast("double").alias(C.UNITS),
        C.DISCOUNT,
    )


def fill_gaps_after(agg: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Add the missing periods of each series (measures null) between its
    first and last present period."""
    w = Window.partitionBy(*keys).orderBy(C.DS) if keys else Window.orderBy(C.DS)
    nxt = F.lead(C.DS).over(w)
    gap = F.when(nxt.isNull(), F.lit(0)).otherwise(periods_between(C.DS, nxt, freq) - 1)
    exploded = agg.withColumn("__gap", gap).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__gap"))))
    filler = F.col("__k") > 0
    measures = [c for c in agg.columns if c not in (*keys, C.DS)]
    return exploded.select(
        *keys,
        step_periods(C.DS, F.col("__k"), freq).alias(C.DS),
        *[F.when(filler, F.lit(None)).otherwise(F.col(m)).alias(m) for m in measures],
    )


def sales_trend(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly revenue (the trend line)."""
    return resample(df, "ME", keys).select(*keys, C.DS, C.REVENUE)
