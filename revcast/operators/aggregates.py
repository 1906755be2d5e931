"""KPIs, breakdowns, shares and report facts over a sales frame.

All are hash aggregations (partial aggregate per task, then one shuffle of
the partial results), so a hot group key costs no more than any other.
Where a result needs both per-group values and a total (shares, YoY), the
transactions are aggregated once to the group level, that small result is
checkpointed (``session.materialize``) and the total is a scalar subquery
over it - one scan of the data, no join to a one-row frame and no
single-partition window over transactions.  Money sums do not depend on
the order of rows (see ``revcast.functions.money``), and no operator rounds:
a caller that presents values rounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.money import money_sum
from revcast.session import materialize

_SUM = "__revenue"


def _grouped_revenue(df: DataFrame, group_col: str, with_units: bool = False) -> DataFrame:
    """Revenue per non-null group value (pandas drops null keys)."""
    aggs = [money_sum(C.REVENUE).alias(_SUM)]
    if with_units:
        aggs.append(F.coalesce(F.sum(C.UNITS), F.lit(0.0)).cast("double").alias(C.UNITS))
    return df.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(*aggs)


def revenue_by(df: DataFrame, group_col: str, ascending: bool = True) -> DataFrame:
    """Revenue and units per group value, sorted by revenue (bar chart data)."""
    g = _grouped_revenue(df, group_col, with_units=True)
    out = g.select(group_col, F.col(_SUM).alias(C.REVENUE), C.UNITS)
    order = F.col(C.REVENUE).asc() if ascending else F.col(C.REVENUE).desc()
    return out.orderBy(order, F.col(group_col).asc())


def revenue_by_category(df: DataFrame, category_col: str = C.CATEGORY) -> DataFrame:
    return revenue_by(df, category_col)


def product_drilldown(
    df: DataFrame, category: str, category_col: str = C.CATEGORY, product_col: str = C.PRODUCT
) -> DataFrame:
    """Revenue and units per product inside one category."""
    if product_col not in df.columns:
        product_col = category_col
    return revenue_by(df.filter(F.col(category_col) == F.lit(category)), product_col)


def revenue_by_region(df: DataFrame, region_col: str = C.REGION) -> DataFrame:
    g = _grouped_revenue(df, region_col)
    return g.select(region_col, F.col(_SUM).alias(C.REVENUE))


def category_summary(df: DataFrame, category_col: str = C.CATEGORY) -> DataFrame:
    """Total revenue, total units, mean price and mean discount (%) per group."""
    return (
        df.filter(F.col(category_col).isNotNull())
        .groupBy(category_col)
        .agg(
            money_sum(C.REVENUE).alias("total_revenue"),
            F.coalesce(F.sum(C.UNITS), F.lit(0.0)).cast("double").alias("total_units"),
            F.avg(C.PRICE).alias("avg_price"),
            (F.avg(C.DISCOUNT) * 100).alias("avg_discount_pct"),
        )
    )


def contribution(df: DataFrame, group_col: str) -> DataFrame:
    """Revenue per group, its share of the total (%) and the grand total.

    The total covers every row (a null group counts towards it but is not
    listed), as the shares of a report are of total revenue.
    """
    g = materialize(df.groupBy(group_col).agg(money_sum(C.REVENUE).alias(_SUM)))
    return contribution_from(g, group_col)


def contribution_from(g: DataFrame, group_col: str) -> DataFrame:
    """``contribution`` from a frame of per-group sums (``__revenue``)."""
    total = g.agg(money_sum(_SUM)).scalar()
    revenue = F.col(_SUM)
    return g.filter(F.col(group_col).isNotNull()).select(
        group_col,
        revenue.alias(C.REVENUE),
        F.when(total > 0, revenue / total * 100).otherwise(F.lit(0.0)).alias("pct"),
        total.alias("total_revenue"),
    )


def category_share(df: DataFrame, category_col: str = C.CATEGORY) -> DataFrame:
    return contribution(df, category_col)


def region_contribution(df: DataFrame, region_col: str = C.REGION) -> DataFrame:
    return contribution(df, region_col)


def category_contribution(df: DataFrame, category_col: str = C.CATEGORY) -> DataFrame:
    return contribution(df, category_col)


def sales_facts(df: DataFrame, *groups: str | Column) -> DataFrame:
    """Sums and counts per group from which KPIs, growth, shares and means follow.

    ``sales_revenue, units_sold, __rows, __price, __prices, __disc, __discs, last_date``:
    sums of revenue, units, prices and discounts, and how many rows, prices and
    discounts they are of.  Price and date figures are left out where the frame
    has no such column.
    """
    optional = []
    if C.PRICE in df.columns:
        optional += [F.sum(C.PRICE).alias("__price"), F.count(C.PRICE).alias("__prices")]
    if C.DATE in df.columns:
        optional.append(F.max(C.DATE).alias("last_date"))
    return df.groupBy(*groups).agg(
        money_sum(C.REVENUE).alias(C.REVENUE),
        F.coalesce(F.sum(C.UNITS), F.lit(0.0)).cast("double").alias(C.UNITS),
        F.count(F.lit(1)).alias("__rows"),
        F.sum(C.DISCOUNT).alias("__disc"),
        F.count(C.DISCOUNT).alias("__discs"),
        *optional,
    )


def category_summary_from(facts: DataFrame, category_col: str = C.CATEGORY) -> DataFrame:
    """``category_summary`` from ``sales_facts`` grouped by the category at least."""
    return (
        facts.filter(F.col(category_col).isNotNull())
        .groupBy(category_col)
        .agg(
            money_sum(C.REVENUE).alias("total_revenue"),
            F.sum(C.UNITS).alias("total_units"),
            F.try_divide(F.sum("__price"), F.sum("__prices")).alias("avg_price"),
            (F.try_divide(F.sum("__disc"), F.sum("__discs")) * 100).alias("avg_discount_pct"),
        )
    )


def kpi_summary(df: DataFrame) -> DataFrame:
    """Total revenue, units, mean discount (%), average order value, rows."""
    return kpi_summary_from(sales_facts(df))


def kpi_summary_from(facts: DataFrame) -> DataFrame:
    """``kpi_summary`` from ``sales_facts`` of any grouping."""
    base = facts.agg(
        money_sum(C.REVENUE).alias("total_revenue"),
        F.coalesce(F.sum(C.UNITS), F.lit(0.0)).alias("total_units"),
        (F.try_divide(F.sum("__disc"), F.sum("__discs")) * 100).alias("avg_discount_pct"),
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("bigint").alias("row_count"),
    )
    return base.select(
        "total_revenue",
        "total_units",
        "avg_discount_pct",
        F.when(F.col("row_count") > 0, F.col("total_revenue") / F.col("row_count"))
        .otherwise(F.lit(0.0))
        .alias("avg_order_value"),
        "row_count",
    )


def yoy_growth(df: DataFrame, date_col: str = C.DATE) -> DataFrame:
    """Latest calendar year against the year before it.

    Growth is 0.0 when the previous year's revenue is not positive and null
    (label ``N/A``) when the data hold a single year.  The latest year may be
    partial; it is compared as is.
    """
    return yoy_growth_from(
        materialize(df.groupBy(F.year(date_col).alias(C.YEAR)).agg(money_sum(C.REVENUE).alias(C.REVENUE)))
    )


def yoy_growth_from(per_year: DataFrame) -> DataFrame:
    """``yoy_growth`` from revenue sums with their ``year`` (several rows of a year add up)."""
    yearly = per_year.filter(F.col(C.YEAR).isNotNull()).groupBy(C.YEAR).agg(money_sum(C.REVENUE).alias(_SUM))
    latest = yearly.agg(F.max(C.YEAR)).scalar()
    agg = yearly.agg(
        F.max(C.YEAR).alias("latest_year"),
        F.count(F.lit(1)).alias("n_years"),
        money_sum(F.when(F.col(C.YEAR) == latest, F.col(_SUM))).alias("latest_sales"),
        money_sum(F.when(F.col(C.YEAR) == latest - 1, F.col(_SUM))).alias("prev_sales"),
    )
    growth = (
        F.when(F.col("n_years") <= 1, F.lit(None).cast("double"))
        .when(F.col("prev_sales") > 0, (F.col("latest_sales") - F.col("prev_sales")) / F.col("prev_sales") * 100)
        .otherwise(F.lit(0.0))
    )
    return agg.withColumn("yoy_growth_pct", growth).withColumn(
        "yoy_label",
        F.when(F.col("yoy_growth_pct").isNull(), F.lit("N/A (Multi-year data required)")).otherwise(
            F.format_string("%+.1f%% YoY", F.col("yoy_growth_pct"))
        ),
    )


def report_kpis(df: DataFrame) -> DataFrame:
    """Revenue, profit, units, average order value and margin (%) for a report.

    Without a ``total_profit`` column profit is revenue x 0.2134.
    """
    has_profit = C.PROFIT in df.columns
    aggs = [
        money_sum(C.REVENUE).alias(_SUM),
        F.coalesce(F.sum(C.UNITS), F.lit(0.0)).alias("__units"),
        F.count(F.lit(1)).alias("row_count"),
    ]
    if has_profit:
        aggs.append(money_sum(C.PROFIT).alias("__profit"))
    return report_kpis_from(df.agg(*aggs), has_profit)


def report_kpis_from(base: DataFrame, has_profit: bool) -> DataFrame:
    """``report_kpis`` from one row of sums (revenue, units, rows, profit)."""
    revenue = F.col(_SUM)
    if has_profit:
        profit = F.col("__profit")
    else:
        profit = revenue * F.lit(C.NO_CATEGORY_MARGIN)
    out = base.select(
        revenue.alias("total_revenue"),
        profit.alias("total_profit"),
        F.col("__units").cast("bigint").alias("total_units"),
        "row_count",
    )
    return out.select(
        "total_revenue",
        "total_profit",
        "total_units",
        F.when(F.col("row_count") > 0, F.col("total_revenue") / F.col("row_count"))
        .otherwise(F.lit(0.0))
        .alias("avg_order_value"),
        F.when(F.col("total_revenue") > 0, F.col("total_profit") / F.col("total_revenue") * 100)
        .otherwise(F.lit(0.0))
        .alias("margin_pct"),
        "row_count",
    )


def top_products(df: DataFrame, n: int = 5, product_col: str = C.PRODUCT) -> DataFrame:
    """The ``n`` products with the highest revenue, ranked 1..n.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps
    its own top ``n`` and only those rows reach the final merge.  Ties on
    revenue are broken by product name so the result is deterministic.
    """
    return top_products_from(_grouped_revenue(df, product_col), n, product_col)


def top_products_from(g: DataFrame, n: int = 5, product_col: str = C.PRODUCT) -> DataFrame:
    """``top_products`` from per-product sums (``__revenue``)."""
    g = g.filter(F.col(product_col).isNotNull())
    top = (
        g.select(product_col, F.col(_SUM).alias(C.REVENUE))
        .orderBy(F.col(C.REVENUE).desc(), F.col(product_col).asc())
        .limit(n)
    )
    rank = F.row_number().over(Window.orderBy(F.col(C.REVENUE).desc(), F.col(product_col).asc()))
    return top.withColumn("rank", rank)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """``<revenue rounded to 1000>_<units>_<rows>`` summary key of a frame."""
    base = df.agg(
        money_sum(C.REVENUE).alias(_SUM),
        F.coalesce(F.sum(C.UNITS), F.lit(0.0)).alias("__units"),
        F.count(F.lit(1)).alias("row_count"),
    )
    # As a decimal, so that a half is a half; beyond its range the text of the double stands.
    rounded = F.coalesce(
        F.bround(F.expr(f"try_cast({_SUM} AS decimal(30,6))"), -3).cast("decimal(30,0)").cast("string"),
        F.col(_SUM).cast("string"),
    )
    return base.select(
        F.concat_ws(
            "_",
            F.concat(rounded, F.lit(".0")),
            F.col("__units").cast("bigint").cast("string"),
            F.col("row_count").cast("string"),
        ).alias("fingerprint")
    )
