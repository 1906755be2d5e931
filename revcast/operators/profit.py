"""Profit margin lookup and total profit (category -> margin, with defaults).

The margin table is a parameter.  A Python mapping becomes a map literal, so
the lookup is a codegen'd expression with no join at all.  A DataFrame table
is joined: broadcast when its measured bytes are under ``broadcast_bytes``, a
plain left join on the key otherwise.  A key with two different values is an
error.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.coerce import qcol

#: Most bytes of keys and values that a lookup table may have to be broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(table: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for ``table`` if its rows add up to at most ``limit`` bytes by ``size``, measured now."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= limit else table


def find_category_column(df: DataFrame) -> str | None:
    """First column whose name normalises to ``product_category``."""
    for name in df.columns:
        if name.lower().replace(" ", "_") == C.CATEGORY:
            return name
    return None


def map_literal(mapping: Mapping) -> Column:
    if not mapping:
        return F.create_map().cast("map<string,double>")
    items = []
    for key, value in mapping.items():
        items += [F.lit(key), F.lit(value)]
    return F.create_map(*items)


def lookup_with_default(
    df: DataFrame,
    key: str,
    table: Mapping | DataFrame,
    out: str,
    default: float,
    table_key: str = "key",
    table_value: str = "value",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left equi-lookup of ``key`` in ``table``; misses and null keys get ``default``.

    Repeated rows of the table count once; keys with different values raise.
    """
    if isinstance(table, Mapping):
        value = F.try_element_at(map_literal(table), qcol(key))
        return df.withColumn(out, F.coalesce(value.cast("double"), F.lit(float(default))))
    dim = table.select(F.col(table_key).alias("__lk"), F.col(table_value).alias("__lv")).distinct()
    clash = dim.groupBy("__lk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND __lk IS NOT NULL").first()
    if clash is not None:
        raise ValueError(f"The lookup table has {clash['n']} values for {clash['__lk']!r}")
    dim = broadcast_if_small(dim, F.coalesce(F.octet_length(F.col("__lk").cast("string")), F.lit(0)) + 16, broadcast_bytes)
    joined = df.join(dim, qcol(key) == dim["__lk"], "left")
    return joined.withColumn(out, F.coalesce(F.col("__lv").cast("double"), F.lit(float(default)))).drop(
        "__lk", "__lv"
    )


def calculate_profit(
    df: DataFrame,
    margins: Mapping | DataFrame | None = None,
    revenue_col: str = C.REVENUE,
) -> DataFrame:
    """Add ``profit_margin`` (category lookup) and ``total_profit`` = revenue x margin."""
    margins = C.DEFAULT_MARGINS if margins is None else margins
    category = find_category_column(df)
    if category is None:
        out = df.withColumn(C.MARGIN, F.lit(C.NO_CATEGORY_MARGIN))
    else:
        out = lookup_with_default(df, category, margins, C.MARGIN, C.UNKNOWN_CATEGORY_MARGIN)
    return out.withColumn(C.PROFIT, F.col(revenue_col) * F.col(C.MARGIN))
