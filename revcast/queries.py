"""Registered queries: one per operator of the inventory, over the test tables.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and reads the whole sales
view (or frames Spark derives from it).  The matching DuckDB statement is
registered next to it in ``revcast.oracle.ORACLE`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.operators import aggregates as A
from revcast.operators.profit import calculate_profit
from revcast.functions.money import money_sum
from revcast.oracle import PROFIT_CTE, cents, half_up, mdec, msum, oracle, total, with_sales
from revcast.sources.tables import sales_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales rows with profit columns."""
    return calculate_profit(sales_view(spark, sf_dir))


def monthly(spark: SparkSession, sf_dir: str, keys, freq: str = "ME") -> DataFrame:
    """Gap-free periodic series of the sales rows per ``keys``."""
    from revcast.operators.periods import resample

    return resample(sales(spark, sf_dir), freq, keys)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns for presentation and comparison.

    Sums of money first to four digits more, so that one a hair below a half cent
    is rounded as the half that it is.
    """
    return df.withColumns(
        {c: F.round(F.round(c, d + 4) if c in SUMS or c.startswith("sales_lag_") else F.col(c), d) for c, d in digits.items()}
    )


SUMS = {C.REVENUE, C.PROFIT, "total_revenue", "total_profit", "latest_sales", "prev_sales", "sales", "value"}
MONEY = {C.REVENUE: 2}
MONEY_PROFIT = {C.REVENUE: 2, C.PROFIT: 2}
SHARE = {C.REVENUE: 2, "pct": 6, "total_revenue": 2}
KPIS = {"total_revenue": 2, "avg_discount_pct": 6, "avg_order_value": 2}


# ---------------------------------------------------------------------------
# Sales view and profit
# ---------------------------------------------------------------------------
@query("sales_view")
def q_sales_view(spark, sf_dir):
    return sales_view(spark, sf_dir)


oracle("sales_view", with_sales() + "SELECT * FROM sales")


@query("profit_by_category")
def q_profit_by_category(spark, sf_dir):
    df = sales(spark, sf_dir)
    out = df.groupBy(C.CATEGORY).agg(
        F.max(C.MARGIN).alias(C.MARGIN),
        money_sum(C.REVENUE).alias(C.REVENUE),
        money_sum(C.PROFIT).alias(C.PROFIT),
    )
    return rounded(out, MONEY_PROFIT)


oracle(
    "profit_by_category",
    with_sales(PROFIT_CTE)
    + f"""SELECT product_category, MAX(profit_margin) AS profit_margin,
       {msum('sales_revenue')} AS sales_revenue, {msum('total_profit')} AS total_profit
FROM profit GROUP BY product_category""",
)

# A margin table keyed by some of the test data's categories (a parameter),
# so the lookup join has both hits and misses.
CUSTOM_MARGINS = [("STANDARD", 0.2134), ("PROMO", 0.25), ("LARGE", 0.32), ("SMALL", 0.18)]


@query("profit_by_category_table")
def q_profit_by_category_table(spark, sf_dir):
    table = spark.createDataFrame(CUSTOM_MARGINS, "key string, value double")
    df = calculate_profit(sales_view(spark, sf_dir), margins=table)
    out = df.groupBy(C.CATEGORY).agg(
        F.max(C.MARGIN).alias(C.MARGIN),
        money_sum(C.REVENUE).alias(C.REVENUE),
        money_sum(C.PROFIT).alias(C.PROFIT),
    )
    return rounded(out, MONEY_PROFIT)


oracle(
    "profit_by_category_table",
    with_sales(
        "m(key, value) AS (VALUES ('STANDARD', 0.2134), ('PROMO', 0.25), ('LARGE', 0.32), ('SMALL', 0.18))",
        """p AS (SELECT s.*, COALESCE(CAST(m.value AS DOUBLE), 0.22) AS profit_margin
              FROM sales s LEFT JOIN m ON s.product_category = m.key)""",
    )
    + f"""SELECT product_category, MAX(profit_margin) AS profit_margin,
       {msum('sales_revenue')} AS sales_revenue, {msum('sales_revenue * profit_margin')} AS total_profit
FROM p GROUP BY product_category""",
)


# ---------------------------------------------------------------------------
# Breakdowns and KPIs
# ---------------------------------------------------------------------------
@query("revenue_by_category")
def q_revenue_by_category(spark, sf_dir):
    return rounded(A.revenue_by_category(sales(spark, sf_dir)), MONEY)


oracle(
    "revenue_by_category",
    with_sales()
    + f"""SELECT product_category, {msum('sales_revenue')} AS sales_revenue,
       CAST(COALESCE(SUM(units_sold), 0) AS DOUBLE) AS units_sold
FROM sales WHERE product_category IS NOT NULL GROUP BY product_category""",
)

DRILLDOWN_CATEGORY = "PROMO"


@query("product_drilldown")
def q_product_drilldown(spark, sf_dir):
    return rounded(A.product_drilldown(sales(spark, sf_dir), DRILLDOWN_CATEGORY), MONEY)


oracle(
    "product_drilldown",
    with_sales()
    + f"""SELECT product, {msum('sales_revenue')} AS sales_revenue,
       CAST(COALESCE(SUM(units_sold), 0) AS DOUBLE) AS units_sold
FROM sales WHERE product_category = '{DRILLDOWN_CATEGORY}' AND product IS NOT NULL GROUP BY product""",
)


@query("revenue_by_region")
def q_revenue_by_region(spark, sf_dir):
    return rounded(A.revenue_by_region(sales(spark, sf_dir)), MONEY)


oracle(
    "revenue_by_region",
    with_sales() + f"SELECT region, {msum('sales_revenue')} AS sales_revenue FROM sales "
    "WHERE region IS NOT NULL GROUP BY region",
)


@query("category_summary")
def q_category_summary(spark, sf_dir):
    return rounded(
        A.category_summary(sales(spark, sf_dir)), {"total_revenue": 2, "avg_price": 4, "avg_discount_pct": 6}
    )


oracle(
    "category_summary",
    with_sales()
    + f"""SELECT product_category, {msum('sales_revenue')} AS total_revenue,
       CAST(COALESCE(SUM(units_sold), 0) AS DOUBLE) AS total_units,
       ROUND(AVG(price_per_unit), 4) AS avg_price, ROUND(AVG(discount) * 100, 6) AS avg_discount_pct
FROM sales WHERE product_category IS NOT NULL GROUP BY product_category""",
)


def _contribution_sql(col: str) -> str:
    return with_sales(
        f"g AS (SELECT {col}, {mdec('sales_revenue')} AS d FROM sales GROUP BY {col})",
        "t AS (SELECT CAST(SUM(d) AS DOUBLE) AS total FROM g)",
    ) + f"""SELECT {col}, {cents('d')} AS sales_revenue,
       ROUND(CASE WHEN t.total > 0 THEN CAST(d AS DOUBLE) / t.total * 100 ELSE 0.0 END, 6) AS pct,
       {half_up('t.total')} AS total_revenue
FROM g, t WHERE {col} IS NOT NULL"""


@query("category_share")
def q_category_share(spark, sf_dir):
    return rounded(A.category_share(sales(spark, sf_dir)), SHARE)


oracle("category_share", _contribution_sql("product_category"))


@query("region_contribution")
def q_region_contribution(spark, sf_dir):
    return rounded(A.region_contribution(sales(spark, sf_dir)), SHARE)


oracle("region_contribution", _contribution_sql("region"))


@query("category_contribution")
def q_category_contribution(spark, sf_dir):
    return rounded(A.category_contribution(sales(spark, sf_dir)), SHARE)


oracle("category_contribution", _contribution_sql("product_category"))


@query("kpi_summary")
def q_kpi_summary(spark, sf_dir):
    return rounded(A.kpi_summary(sales(spark, sf_dir)), KPIS)


oracle(
    "kpi_summary",
    with_sales(
        f"""k AS (SELECT {total('sales_revenue')} AS total_revenue,
       CAST(COALESCE(SUM(units_sold), 0) AS DOUBLE) AS total_units,
       ROUND(AVG(discount) * 100, 6) AS avg_discount_pct, COUNT(*) AS row_count FROM sales)"""
    )
    + f"""SELECT {half_up('total_revenue')} AS total_revenue, total_units, avg_discount_pct,
       CASE WHEN row_count > 0 THEN ROUND(total_revenue / row_count, 2) ELSE 0.0 END AS avg_order_value,
       row_count
FROM k""",
)


@query("yoy_growth")
def q_yoy_growth(spark, sf_dir):
    return rounded(A.yoy_growth(sales(spark, sf_dir)), {"latest_sales": 2, "prev_sales": 2, "yoy_growth_pct": 6})


oracle(
    "yoy_growth",
    with_sales(
        f"y AS (SELECT CAST(year(date) AS INTEGER) AS year, {mdec('sales_revenue')} AS d FROM sales "
        "WHERE date IS NOT NULL GROUP BY 1)",
        f"""a AS (SELECT MAX(year) AS latest_year, COUNT(*) AS n_years,
       COALESCE(CAST(SUM(CASE WHEN year = (SELECT MAX(year) FROM y) THEN d END) AS DOUBLE), 0.0) AS latest_sales,
       COALESCE(CAST(SUM(CASE WHEN year = (SELECT MAX(year) FROM y) - 1 THEN d END) AS DOUBLE), 0.0) AS prev_sales
       FROM y)""",
        """b AS (SELECT *, CASE WHEN n_years <= 1 THEN NULL
                 WHEN prev_sales > 0 THEN (latest_sales - prev_sales) / prev_sales * 100
                 ELSE 0.0 END AS yoy_growth_pct FROM a)""",
    )
    + f"""SELECT * REPLACE ({half_up('latest_sales')} AS latest_sales, {half_up('prev_sales')} AS prev_sales,
       ROUND(yoy_growth_pct, 6) AS yoy_growth_pct), CASE WHEN yoy_growth_pct IS NULL THEN 'N/A (Multi-year data required)'
                ELSE printf('%+.1f%% YoY', yoy_growth_pct) END AS yoy_label FROM b""",
)


@query("report_kpis")
def q_report_kpis(spark, sf_dir):
    digits = {"total_revenue": 2, "total_profit": 2, "avg_order_value": 6, "margin_pct": 6}
    return rounded(A.report_kpis(sales(spark, sf_dir)), digits)


oracle(
    "report_kpis",
    with_sales(
        PROFIT_CTE,
        f"""k AS (SELECT {total('sales_revenue')} AS total_revenue, {total('total_profit')} AS total_profit,
       CAST(COALESCE(SUM(units_sold), 0) AS BIGINT) AS total_units, COUNT(*) AS row_count FROM profit)""",
    )
    + f"""SELECT {half_up('total_revenue')} AS total_revenue, {half_up('total_profit')} AS total_profit, total_units,
       ROUND(CASE WHEN row_count > 0 THEN total_revenue / row_count ELSE 0.0 END, 6) AS avg_order_value,
       ROUND(CASE WHEN total_revenue > 0 THEN total_profit / total_revenue * 100 ELSE 0.0 END, 6) AS margin_pct,
       row_count
FROM k""",
)


@query("top_products")
def q_top_products(spark, sf_dir):
    return rounded(A.top_products(sales(spark, sf_dir)), MONEY)


oracle(
    "top_products",
    with_sales(
        f"g AS (SELECT product, {msum('sales_revenue')} AS sales_revenue FROM sales "
        "WHERE product IS NOT NULL GROUP BY product)"
    )
    + """SELECT product, sales_revenue,
       CAST(ROW_NUMBER() OVER (ORDER BY sales_revenue DESC, product ASC) AS INTEGER) AS rank
FROM g ORDER BY sales_revenue DESC, product ASC LIMIT 5""",
)


@query("dataset_fingerprint")
def q_dataset_fingerprint(spark, sf_dir):
    return A.dataset_fingerprint(sales(spark, sf_dir))


oracle(
    "dataset_fingerprint",
    with_sales(
        f"k AS (SELECT {mdec('sales_revenue')} AS d, COALESCE(SUM(units_sold), 0) AS u, COUNT(*) AS n FROM sales)"
    )
    + """SELECT CAST(CAST(ROUND_EVEN(COALESCE(d, 0), -3) AS BIGINT) AS VARCHAR) || '.0' || '_' ||
       CAST(CAST(u AS BIGINT) AS VARCHAR) || '_' || CAST(n AS VARCHAR) AS fingerprint FROM k""",
)


# Query families registered in their own modules (they import ``query``).
from revcast import queries_ingest as _ingest  # noqa: E402,F401
from revcast import queries_series as _series  # noqa: E402,F401
from revcast import queries_more as _more  # noqa: E402,F401
