"""Report facts as one long table: ``(section, rank, item, value, pct)``.

Sections by report type:

* ``executive`` - summary KPIs, region contribution, category contribution,
  top products;
* ``regional``  - summary KPIs and region contribution;
* ``products``  - summary KPIs, category contribution and top products.

The transactions are aggregated once, to one row per (region, category,
product) with revenue/profit sums, units and row counts; that frame is
checkpointed and every section is derived from it (sums of sums do not depend on row order either),
so a report is one scan and one shuffle of the data however many sections it
has.  Rendering the facts as HTML is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.money import money_sum
from revcast.operators.aggregates import _SUM, contribution_from, report_kpis_from, top_products_from
from revcast.session import materialize

REPORT_TYPES = ("executive", "regional", "products")
SUMMARY_ITEMS = ["total_revenue", "total_profit", "margin_pct", "total_units", "avg_order_value"]
REPORT_SCHEMA = "section string, rank int, item string, value double, pct double"


def _pre_aggregate(df: DataFrame) -> tuple[DataFrame, bool]:
    has_profit = C.PROFIT in df.columns
    aggs = [
        money_sum(C.REVENUE).alias(_SUM),
        F.coalesce(F.sum(C.UNITS), F.lit(0.0)).alias("__units"),
        F.count(F.lit(1)).alias("__rows"),
    ]
    if has_profit:
        aggs.append(money_sum(C.PROFIT).alias("__profit"))
    return materialize(df.groupBy(C.REGION, C.CATEGORY, C.PRODUCT).agg(*aggs)), has_profit


def _summary(pre: DataFrame, has_profit: bool) -> DataFrame:
    sums = [
        money_sum(_SUM).alias(_SUM),
        F.coalesce(F.sum("__units"), F.lit(0.0)).alias("__units"),
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("bigint").alias("row_count"),
    ]
    if has_profit:
        sums.append(money_sum("__profit").alias("__profit"))
    k = report_kpis_from(pre.agg(*sums), has_profit)
    rows = [
        F.struct(
            F.lit(i + 1).alias("rank"), F.lit(name).alias("item"), F.col(name).cast("double").alias("value")
        )
        for i, name in enumerate(SUMMARY_ITEMS)
    ]
    return k.select(F.inline(F.array(*rows))).select(
        F.lit("summary").alias("section"), "rank", "item", "value", F.lit(None).cast("double").alias("pct")
    )


def _shares(pre: DataFrame, col: str, section: str) -> DataFrame:
    """Revenue and share per value (one row per region or category).

    Listing sections are not ranked (``rank`` 0): numbering every value would
    need a single-partition window over all of them; order by ``value`` when
    presenting.
    """
    c = contribution_from(pre.groupBy(col).agg(money_sum(_SUM).alias(_SUM)), col)
    return c.select(
        F.lit(section).alias("section"),
        F.lit(0).alias("rank"),
        F.col(col).alias("item"),
        F.col(C.REVENUE).alias("value"),
        F.col("pct"),
    )


def _top(pre: DataFrame, n: int) -> DataFrame:
    t = top_products_from(pre.groupBy(C.PRODUCT).agg(money_sum(_SUM).alias(_SUM)), n)
    return t.select(
        F.lit("top_products").alias("section"),
        F.col("rank").cast("int").alias("rank"),
        F.col(C.PRODUCT).alias("item"),
        F.col(C.REVENUE).alias("value"),
        F.lit(None).cast("double").alias("pct"),
    )


def report(df: DataFrame, report_type: str = "executive", top_n: int = 5) -> DataFrame:
    if report_type not in REPORT_TYPES:
        raise ValueError(f"report_type must be one of {REPORT_TYPES}")
    pre, has_profit = _pre_aggregate(df)
    parts = [_summary(pre, has_profit)]
    if report_type in ("executive", "regional"):
        parts.append(_shares(pre, C.REGION, "region"))
    if report_type in ("executive", "products"):
        parts.append(_shares(pre, C.CATEGORY, "category"))
        parts.append(_top(pre, top_n))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
