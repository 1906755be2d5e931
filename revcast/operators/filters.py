"""Filters, option lists and profiling of a sales frame.

Filters are plain predicates on source columns, so Catalyst combines them
(``CombineFilters``), turns value lists into ``InSet`` and pushes them into
the parquet scan (or through the joins of ``sales_view``).  Filter on
``date`` itself, not on derived calendar columns, to keep that pushdown.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast import columns as C
from revcast.functions.coerce import qcol

MAX_CATEGORICAL_DISTINCT = 15


def categorical_profile(
    df: DataFrame,
    exclude: Iterable[str] = C.NON_CATEGORICAL,
    max_distinct: int = MAX_CATEGORICAL_DISTINCT,
    approx: bool = False,
) -> DataFrame:
    """One row per candidate filter column: type, distinct count, categorical?

    A column is categorical when it is a string or has fewer than
    ``max_distinct`` distinct values.  All counts come from one aggregation
    (Spark rewrites several distinct counts into one Expand + two-level
    aggregate, deduplicating per task before the shuffle); ``approx=True``
    uses HyperLogLog sketches instead.
    """
    excluded = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in excluded]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, data_type string, n_distinct bigint, is_categorical int")
    counter = F.approx_count_distinct if approx else F.count_distinct
    counts = df.agg(*[counter(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").cast("bigint").alias("n_distinct"),
            (
                F.lit(isinstance(f.dataType, T.StringType)) | (F.col(f"c{i}") < max_distinct)
            ).cast("int").alias("is_categorical"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def categorical_columns(
    df: DataFrame,
    exclude: Iterable[str] = C.NON_CATEGORICAL,
    max_distinct: int = MAX_CATEGORICAL_DISTINCT,
) -> list[str]:
    """Names of the columns that ``categorical_profile`` calls categorical, in
    schema order.  Strings need no job; all others (numbers, booleans, dates) are
    counted in one."""
    excluded = set(exclude)
    names = [f.name for f in df.schema.fields if f.name not in excluded]
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    counted = [n for n in names if n not in strings]
    small = strings
    if counted:
        rows = categorical_profile(df.select(*(qcol(n) for n in counted)), (), max_distinct).filter("is_categorical = 1").collect()
        small = strings | {r["column_name"] for r in rows}
    return [n for n in names if n in small]


def date_bounds(df: DataFrame, date_col: str = C.DATE) -> DataFrame:
    return df.agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def filter_date_range(
    df: DataFrame, start: str | dt.date, end: str | dt.date, date_col: str = C.DATE
) -> DataFrame:
    """Rows with ``start <= date`` and date on or before the ``end`` day.

    The end is inclusive of the whole day (``date < end + 1 day``); on
    date-only data this equals ``date <= end``.
    """
    lo = F.to_timestamp_ntz(F.lit(str(start)))
    hi = F.to_timestamp_ntz(F.lit(str(end))) + F.expr("INTERVAL 1 DAY")
    return df.filter((F.col(date_col) >= lo) & (F.col(date_col) < hi))


def distinct_values(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Sorted distinct non-null values per column, as ``(column_name, value)``.

    One scan: every row emits a (column, value) pair per column, and a single
    ``distinct`` (deduplicated per task before its shuffle) keeps each once.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    out = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    return out.orderBy("column_name", "value")


def filter_isin(df: DataFrame, selections: Mapping[str, Iterable]) -> DataFrame:
    """AND of membership filters; an empty selection leaves its column unfiltered."""
    out = df
    for col, values in selections.items():
        values = list(values)
        if values:
            out = out.filter(F.col(col).isin(values))
    return out


def is_empty(df: DataFrame) -> bool:
    """True when no row matches (stops at the first row found)."""
    return df.isEmpty()


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.filter(F.col(col) == F.lit(value))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.dropna(how="any")
