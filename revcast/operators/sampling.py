"""Bounded views of a frame: the explorer page and the scatter-plot sample.

Both are the first ``n`` rows in some order.  A plain ordered limit would send
``n`` rows of every task to the last one, which at many tasks is far more than
the result.  So each view first finds a bound that a little more than ``n`` rows
meet, from counts alone, and only rows within it are sorted.  The bound never
changes the result: all of the first ``n`` rows meet it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast import columns as C
from revcast.functions.coerce import field_type, is_temporal_type

EXPLORER_ROWS = 1000
SAMPLE_ROWS = 2000
SAMPLE_SEED = 42


def explorer_page(df: DataFrame, n: int = EXPLORER_ROWS, order: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a total order plus the filtered frame's row count.

    The default order is the date, then every other column, so ties cannot
    make the page depend on partitioning.  Rows are counted by day once; the
    days whose rows come first bound the sort, and the total is their sum.
    """
    order = list(order) if order else [C.DATE] + [c for c in df.columns if c != C.DATE]
    if is_temporal_type(field_type(df, order[0])):
        days = df.groupBy(F.to_date(order[0]).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
        # One row per day; windows and sums over them stay small whatever the table.
        upto = F.sum("rows").over(Window.orderBy(F.col("day").asc_nulls_first()))
        known = days.select("day", "rows", upto.alias("upto")).agg(
            F.sum("rows").alias("total"),
            F.min(F.when(F.col("upto") >= n, F.coalesce("day", F.lit("0001-01-01").cast("date")))).alias("last"),
        ).first()
        total = F.lit(known["total"] or 0).cast("bigint")
        first = df
        if known["last"] is not None:
            day_after = F.lit(known["last"]).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
            first = df.filter(F.col(order[0]).isNull() | (F.col(order[0]) < day_after))
    else:
        total, first = df.agg(F.count(F.lit(1))).scalar(), df
    return first.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n).withColumn("total_rows", total)


SCATTER_COLUMNS = [C.PRICE, C.UNITS, C.REVENUE, C.CATEGORY, C.PRODUCT, C.REGION, C.DISCOUNT]


def sample_key(df: DataFrame, seed: int = SAMPLE_SEED):
    """Hex MD5 of the seed and the row's values as text (a null as an empty text,
    doubles as whole ten-thousandths)."""

    def text(c: str):
        if is_temporal_type(field_type(df, c)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if isinstance(field_type(df, c), T.DoubleType):
            # A quarter keeps halves and float noise around whole numbers off the floor's edge.
            return F.floor(F.col(c) * 10000 + 0.25).cast("string")
        return F.col(c).cast("string")

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(text(c), F.lit("")) for c in df.columns]).cast("binary"))


def price_volume_sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most ``n`` rows for the price-vs-units scatter, chosen by hash.

    Rows are ranked by an MD5 of the seed and their values, and the smallest
    ``n`` kept: deterministic for a given seed (unlike ``sample``) and uniform
    over distinct rows.  Rows are counted by the first four hex digits of the
    hash (65,536 groups at most); those that hold the smallest ``n`` bound the
    sort.  A frame with at most ``n`` rows is returned whole.
    """
    cols = [c for c in SCATTER_COLUMNS if c in df.columns]
    if C.DATE in df.columns:
        cols.append(C.DATE)
    ranked = df.select(*cols, sample_key(df, seed).alias("__h"))
    heads = ranked.groupBy(F.substring("__h", 1, 4).alias("head")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("head"))
    last = heads.select("head", upto.alias("upto")).filter(F.col("upto") >= n).agg(F.min("head")).first()[0]
    if last is not None:
        ranked = ranked.filter(F.substring("__h", 1, 4) <= last)
    return ranked.orderBy("__h", *cols).limit(n).drop("__h")
