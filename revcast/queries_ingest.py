"""Registered queries: ingestion, schema mapping, calendar and filters.

Mapping queries start from the sales view re-expressed the way a raw file
arrives (display-cased or arbitrary column names, text values); the mapping
operators then do all of the parsing, renaming, coercion and defaulting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.coerce import date_order, to_timestamp_utc
from revcast.functions.money import money_sum
from revcast.operators import aggregates as A
from revcast.operators import filters as FL
from revcast.operators.allocation import region_country_allocation
from revcast.operators.calendar import engineer_features
from revcast.operators.periods import resample
from revcast.operators.profit import calculate_profit
from revcast.oracle import MARGIN_CASE, PROFIT_CTE, half_up, msum, oracle, series_ctes, total, with_sales
from revcast.plans import dashboard as D
from revcast.plans.fact_store import FactStore
from revcast.queries import KPIS, query, rounded, sales
from revcast.session import work_dir
from revcast.sources import files
from revcast.sources.mapping import clean_data, map_and_clean, suggest_mappings, undated_rows
from revcast.sources.sales_layout import bucket_sources, read_layout, sales_view_bucketed, stored_sales
from revcast.sources.tables import read_table, sales_view

DISPLAY_NAMES = {
    C.DATE: "Date",
    C.CATEGORY: "Product Category",
    C.PRODUCT: "Product",
    C.REGION: "Region",
    C.UNITS: "Units Sold",
    C.PRICE: "Price Per Unit",
    C.DISCOUNT: "Discount",
    C.REVENUE: "Sales Revenue",
}


def raw_text_frame(spark: SparkSession, sf_dir: str, with_revenue: bool = True) -> DataFrame:
    """Sales rows as a header CSV would give them: display names, all text."""
    s = sales_view(spark, sf_dir)
    cols = [F.date_format(C.DATE, "yyyy-MM-dd").alias(DISPLAY_NAMES[C.DATE])]
    for name in C.SALES_COLUMNS[1:]:
        if name == C.REVENUE and not with_revenue:
            continue
        cols.append(F.col(name).cast("string").alias(DISPLAY_NAMES[name]))
    return s.select(*cols)


def raw_renamed_frame(spark: SparkSession, sf_dir: str, percent_discount: bool = False) -> DataFrame:
    """Sales rows under arbitrary column names (as an export from another system)."""
    s = sales_view(spark, sf_dir)
    discount = (
        (F.col(C.DISCOUNT) * 100).alias("discount_pct") if percent_discount else F.col(C.DISCOUNT).alias("discount_rate")
    )
    return s.select(
        F.date_format(C.DATE, "yyyy-MM-dd HH:mm:ss").alias("transaction_time"),
        F.col(C.PRODUCT).alias("item_name"),
        F.col(C.CATEGORY).alias("dept"),
        F.col(C.REGION).alias("sales_territory"),
        F.col(C.UNITS).alias("qty"),
        discount,
        F.col(C.PRICE).alias("unit_price"),
        F.col(C.REVENUE).alias("net_revenue_usd"),
    )


# ---------------------------------------------------------------------------
# Strict cleaning and lenient mapping
# ---------------------------------------------------------------------------
@query("clean_sales")
def q_clean_sales(spark, sf_dir):
    return clean_data(raw_text_frame(spark, sf_dir))


oracle("clean_sales", with_sales(PROFIT_CTE) + "SELECT * FROM profit")


@query("derived_revenue")
def q_derived_revenue(spark, sf_dir):
    return clean_data(raw_text_frame(spark, sf_dir, with_revenue=False))


oracle(
    "derived_revenue",
    with_sales(
        "d AS (SELECT date, product_category, product, region, units_sold, price_per_unit, discount, "
        "units_sold * price_per_unit * (1.0 - discount) AS sales_revenue FROM sales)"
    )
    + f"""SELECT *, CAST({MARGIN_CASE} AS DOUBLE) AS profit_margin,
       sales_revenue * CAST({MARGIN_CASE} AS DOUBLE) AS total_profit FROM d""",
)


def _mapped(spark, sf_dir, percent: bool) -> DataFrame:
    raw = raw_renamed_frame(spark, sf_dir, percent_discount=percent)
    date_col, sales_col = suggest_mappings(raw)
    return map_and_clean(raw, date_col, sales_col)


@query("map_sales")
def q_map_sales(spark, sf_dir):
    return _mapped(spark, sf_dir, percent=False)


oracle("map_sales", with_sales(PROFIT_CTE) + "SELECT * FROM profit")


@query("discount_normalise")
def q_discount_normalise(spark, sf_dir):
    return _mapped(spark, sf_dir, percent=True)


oracle(
    "discount_normalise",
    with_sales(
        "pct AS (SELECT date, product_category, product, region, units_sold, price_per_unit, "
        "discount * 100 AS discount_pct, sales_revenue FROM sales)",
        """n AS (SELECT date, product_category, product, region, units_sold, price_per_unit,
              CASE WHEN (SELECT MAX(discount_pct) FROM pct) > 1.0 THEN discount_pct / 100.0 ELSE discount_pct END
              AS discount, sales_revenue FROM pct)""",
    )
    + f"""SELECT *, CAST({MARGIN_CASE} AS DOUBLE) AS profit_margin,
       sales_revenue * CAST({MARGIN_CASE} AS DOUBLE) AS total_profit FROM n""",
)


# ---------------------------------------------------------------------------
# Calendar features
# ---------------------------------------------------------------------------
@query("calendar_features")
def q_calendar_features(spark, sf_dir):
    df = engineer_features(sales_view(spark, sf_dir))
    return df.select(C.DATE, *C.CALENDAR_COLUMNS)


oracle(
    "calendar_features",
    with_sales()
    + """SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN isodow(date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       strftime(date, '%b') AS month_name, CAST(dayofyear(date) AS INTEGER) AS day_of_year
FROM sales""",
)


# ---------------------------------------------------------------------------
# Filters and profiling
# ---------------------------------------------------------------------------
@query("categorical_profile")
def q_categorical_profile(spark, sf_dir):
    return FL.categorical_profile(engineer_features(sales(spark, sf_dir)))


oracle(
    "categorical_profile",
    with_sales()
    + """SELECT 'product_category' AS column_name, 'string' AS data_type, COUNT(DISTINCT product_category) AS n_distinct,
       1 AS is_categorical FROM sales
UNION ALL SELECT 'product', 'string', COUNT(DISTINCT product), 1 FROM sales
UNION ALL SELECT 'region', 'string', COUNT(DISTINCT region), 1 FROM sales""".replace(
        "1 AS is_categorical", "CAST(1 AS INTEGER) AS is_categorical"
    ),
)


@query("date_bounds")
def q_date_bounds(spark, sf_dir):
    return FL.date_bounds(sales_view(spark, sf_dir))


oracle("date_bounds", with_sales() + "SELECT MIN(date) AS min_date, MAX(date) AS max_date FROM sales")

RANGE_START, RANGE_END = "1996-01-01", "1997-12-31"


@query("filter_date_range")
def q_filter_date_range(spark, sf_dir):
    return FL.filter_date_range(sales_view(spark, sf_dir), RANGE_START, RANGE_END)


oracle(
    "filter_date_range",
    with_sales()
    + f"SELECT * FROM sales WHERE date >= TIMESTAMP '{RANGE_START}' "
    f"AND date < TIMESTAMP '{RANGE_END}' + INTERVAL 1 DAY",
)


@query("distinct_values")
def q_distinct_values(spark, sf_dir):
    return FL.distinct_values(sales_view(spark, sf_dir), [C.REGION, C.CATEGORY, C.PRODUCT])


oracle(
    "distinct_values",
    with_sales()
    + """SELECT DISTINCT 'region' AS column_name, region AS value FROM sales WHERE region IS NOT NULL
UNION ALL SELECT DISTINCT 'product_category', product_category FROM sales WHERE product_category IS NOT NULL
UNION ALL SELECT DISTINCT 'product', product FROM sales WHERE product IS NOT NULL""",
)

ISIN_SELECTIONS = {C.REGION: ["ASIA", "EUROPE"], C.CATEGORY: ["PROMO", "STANDARD", "SMALL"], C.PRODUCT: []}


@query("filter_isin")
def q_filter_isin(spark, sf_dir):
    return FL.filter_isin(sales_view(spark, sf_dir), ISIN_SELECTIONS)


oracle(
    "filter_isin",
    with_sales()
    + "SELECT * FROM sales WHERE region IN ('ASIA', 'EUROPE') AND product_category IN ('PROMO', 'STANDARD', 'SMALL')",
)


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------
@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """Write the sales rows as CSV under the shared work folder, read them back."""
    path = files.write_csv(sales_view(spark, sf_dir), work_dir(spark, "sales-csv"))
    schema = ", ".join(
        f"{c} {'timestamp_ntz' if c == C.DATE else 'double' if c in C.NUMERIC_COLUMNS else 'string'}"
        for c in C.SALES_COLUMNS
    )
    return files.load_sales(spark, path, fmt="csv", schema=schema, encoding="UTF-8")


oracle("csv_roundtrip", with_sales() + "SELECT * FROM sales")


ACCENT = " café"


def accented(raw: DataFrame) -> DataFrame:
    return raw.withColumn("Product", F.concat("Product", F.lit(ACCENT)))


ACCENTED_SQL = with_sales(PROFIT_CTE) + f"SELECT * REPLACE (product || '{ACCENT}' AS product) FROM profit"


@query("csv_latin1")
def q_csv_latin1(spark, sf_dir):
    """Write ISO-8859-1 CSV with accented names, then read it without naming the encoding."""
    raw = accented(raw_text_frame(spark, sf_dir))
    path = files.write_csv(raw, work_dir(spark, "sales-latin1"), encoding="ISO-8859-1")
    return clean_data(files.load_sales(spark, path, fmt="csv", schema=None))


oracle("csv_latin1", ACCENTED_SQL)


@query("csv_mixed")
def q_csv_mixed(spark, sf_dir):
    """One folder with UTF-8 and ISO-8859-1 files of accented names; each is read as what it is."""
    raw = accented(raw_text_frame(spark, sf_dir))
    odd = F.col("Units Sold").cast("double") % 2 == 1
    path = files.write_csv(raw.filter(odd), work_dir(spark, "sales-mixed"), encoding="UTF-8")
    files.write_csv(raw.filter(~odd), path, encoding="ISO-8859-1", mode="append")
    return clean_data(files.load_sales(spark, path, fmt="csv", schema=None))


oracle("csv_mixed", ACCENTED_SQL)


# ---------------------------------------------------------------------------
# Input as people send it
# ---------------------------------------------------------------------------
DIRT_KINDS = 11


def dirty_text_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_text_frame`` with one kind of damage per row, by the units sold modulo ``DIRT_KINDS``."""
    raw = raw_text_frame(spark, sf_dir)
    kind = F.col("Units Sold").cast("double").cast("int") % DIRT_KINDS
    damage = {
        0: ("Date", None), 1: ("Date", "not a date"), 2: ("Price Per Unit", "5d"), 3: ("Discount", "n/a"),
        4: ("Sales Revenue", "Infinity"), 5: ("Price Per Unit", " "), 6: ("Sales Revenue", None),
        7: ("Discount", "NaN"), 8: ("Sales Revenue", "1e13"), 9: ("Product Category", None),
    }
    dirty = raw.withColumn("__kind", kind)
    for k, (column, value) in damage.items():
        dirty = dirty.withColumn(column, F.when(F.col("__kind") == k, F.lit(value)).otherwise(F.col(column)))
    return dirty.drop("__kind")


_DIRTY_SQL = f"""kinds AS (SELECT *, CAST(units_sold AS INTEGER) % {DIRT_KINDS} AS k FROM sales),
dirty AS (SELECT date, CASE WHEN k = 9 THEN NULL ELSE product_category END AS product_category, product, region, units_sold,
       CASE WHEN k IN (2, 5) THEN 0.0 ELSE price_per_unit END AS price_per_unit,
       CASE WHEN k IN (3, 7) THEN 0.0 ELSE discount END AS discount,
       CASE WHEN k IN (4, 6) THEN 0.0 WHEN k = 8 THEN 1e13 ELSE sales_revenue END AS sales_revenue
FROM kinds WHERE k > 1)"""


@query("clean_dirty")
def q_clean_dirty(spark, sf_dir):
    """Nulls, junk, infinite and huge numbers, and unreadable dates."""
    return clean_data(dirty_text_frame(spark, sf_dir))


oracle(
    "clean_dirty",
    with_sales(_DIRTY_SQL)
    + f"""SELECT *, CAST({MARGIN_CASE} AS DOUBLE) AS profit_margin,
       sales_revenue * CAST({MARGIN_CASE} AS DOUBLE) AS total_profit FROM dirty""",
)


@query("kpi_extreme")
def q_kpi_extreme(spark, sf_dir):
    """KPIs of rows that hold 1e13 next to cents; sums of such size are compared in millions."""
    kpis = A.kpi_summary(clean_data(dirty_text_frame(spark, sf_dir)))
    return rounded(kpis, {"total_revenue": -6, "avg_discount_pct": 6, "avg_order_value": -6})


oracle(
    "kpi_extreme",
    with_sales(_DIRTY_SQL)
    + """SELECT ROUND(SUM(sales_revenue), -6) AS total_revenue, SUM(units_sold) AS total_units,
       ROUND(AVG(discount) * 100, 6) AS avg_discount_pct, ROUND(SUM(sales_revenue) / COUNT(*), -6) AS avg_order_value,
       COUNT(*) AS row_count FROM dirty""",
)


@query("small_values")
def q_small_values(spark, sf_dir):
    """Monthly series of amounts far below a cent."""
    scaled = sales_view(spark, sf_dir).withColumn(C.REVENUE, F.col(C.REVENUE) / 1e9)
    return rounded(resample(scaled, "ME", [C.REGION]), {C.REVENUE: 14, C.DISCOUNT: 8})


oracle(
    "small_values",
    with_sales(
        *series_ctes([C.REGION]),
    )
    + "SELECT * REPLACE (ROUND(sales_revenue / 1e9, 14) AS sales_revenue, ROUND(discount, 8) AS discount) FROM series",
)


@query("map_colliding")
def q_map_colliding(spark, sf_dir):
    """Several date, place and amount columns, some under names that the mapping makes itself."""
    s = sales_view(spark, sf_dir)
    raw = s.select(
        F.date_format(C.DATE, "yyyy-MM-dd").alias("order_date"),
        F.lit("never").alias("Date"),
        F.col(C.REGION).alias("Country"),
        F.lit("zone").alias("Region"),
        F.col(C.REVENUE).alias("amount"),
        F.lit(-1.0).alias("Sales_Revenue2"),
        F.col(C.UNITS).alias("qty"),
        F.lit("x").alias("Profit_Margin"),
        F.col(C.PRODUCT).alias("Note"),
        F.lit("y").alias("note"),
    )
    return map_and_clean(raw, "order_date", "amount")


oracle(
    "map_colliding",
    with_sales()
    + """SELECT date, 'General' AS product_category, 'Standard Product' AS product, region, units_sold,
       sales_revenue AS price_per_unit, CAST(0.0 AS DOUBLE) AS discount, sales_revenue,
       CAST(-1.0 AS DOUBLE) AS "Sales_Revenue2", product AS "Note", CAST(0.22 AS DOUBLE) AS profit_margin,
       sales_revenue * CAST(0.22 AS DOUBLE) AS total_profit FROM sales""",
)

DATE_FORMS = [
    "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "MM-dd-yy",
    "MMM d, yyyy", "d MMMM yyyy", "dd-MMM-yyyy", "MMMM d yyyy", "M/d/yyyy h:mm a",
]


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, in a form that the key chooses; each 13th is no date, and
    where the day is above 12 some write it first."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    text = F.lit("soon")
    for k, form in enumerate(DATE_FORMS):
        text = F.when(F.col("o_orderkey") % 13 == k, F.date_format("o_orderdate", form)).otherwise(text)
    day_first = (F.col("o_orderkey") % 13 == 5) & (F.dayofmonth("o_orderdate") > 12)
    return orders.select("o_orderkey", F.when(day_first, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(text).alias("ordered"))


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    raw = written_dates(spark, sf_dir)
    return raw.select("o_orderkey", to_timestamp_utc(raw, "ordered").alias("parsed"))


oracle(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed
FROM orders""",
)


def dates_in_numbers(spark: SparkSession, sf_dir: str, both: bool) -> DataFrame:
    """Order dates in three numbers with the day first, or with the month first in every other row."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "d/M/yyyy")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(day) if both else day
    return orders.select(text.alias("ordered"), F.lit(1.0).alias("sales"), F.col("o_orderkey"))


@query("parse_dates_mixed")
def q_parse_dates_mixed(spark, sf_dir):
    """A column of one order is read in it; where both occur, what can be read either way is month first."""
    parts = [
        map_and_clean(dates_in_numbers(spark, sf_dir, both), "ordered", "sales").select(
            F.lit(both).alias("both_orders"), "o_orderkey", F.col(C.DATE).alias("parsed")
        )
        for both in (False, True)
    ]
    return parts[0].unionByName(parts[1])


oracle(
    "parse_dates_mixed",
    """SELECT FALSE AS both_orders, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS parsed FROM orders
UNION ALL SELECT TRUE, o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 1 AND day(o_orderdate) <= 12
  THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS TIMESTAMP) FROM orders""",
)


@query("date_order")
def q_date_order(spark, sf_dir):
    return date_order(dates_in_numbers(spark, sf_dir, True), "ordered")


oracle(
    "date_order",
    """SELECT COUNT(*) FILTER (day(o_orderdate) > 12 AND o_orderkey % 2 = 1) AS n_day_first,
       COUNT(*) FILTER (day(o_orderdate) > 12 AND o_orderkey % 2 = 0) AS n_month_first,
       COUNT(*) FILTER (day(o_orderdate) <= 12) AS n_either FROM orders""",
)


@query("undated_rows")
def q_undated_rows(spark, sf_dir):
    return undated_rows(written_dates(spark, sf_dir), "ordered")


oracle(
    "undated_rows",
    "SELECT COUNT(*) AS n_rows, CAST(SUM(CASE WHEN o_orderkey % 13 = 12 THEN 1 ELSE 0 END) AS BIGINT) AS n_undated FROM orders",
)

# The test data's labels under the names that the default tables list.
CATEGORY_RELABEL = {"STANDARD": "Electronics", "PROMO": "Accessories", "LARGE": "Wearables", "SMALL": "Home Appliances", "MEDIUM": "Others"}
REGION_RELABEL = {"AFRICA": "North", "AMERICA": "East", "ASIA": "South", "EUROPE": "West"}


def relabelled(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    return df.replace(names, subset=[column])


def _relabel_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {column} END"


@query("profit_default_hits")
def q_profit_default_hits(spark, sf_dir):
    """Profit with the default margins, on categories that they list (and one that they do not)."""
    df = calculate_profit(relabelled(sales_view(spark, sf_dir), C.CATEGORY, CATEGORY_RELABEL))
    out = df.groupBy(C.CATEGORY, C.MARGIN).agg(money_sum(C.REVENUE).alias(C.REVENUE), money_sum(C.PROFIT).alias(C.PROFIT))
    return rounded(out, {C.REVENUE: 2, C.PROFIT: 2})


oracle(
    "profit_default_hits",
    with_sales(
        f"r AS (SELECT * REPLACE ({_relabel_sql('product_category', CATEGORY_RELABEL)} AS product_category) FROM sales)",
        f"m AS (SELECT *, CAST({MARGIN_CASE} AS DOUBLE) AS profit_margin FROM r)",
    )
    + f"""SELECT product_category, profit_margin, {msum('sales_revenue')} AS sales_revenue,
       {msum('sales_revenue * profit_margin')} AS total_profit FROM m GROUP BY 1, 2""",
)


@query("allocation_default_hits")
def q_allocation_default_hits(spark, sf_dir):
    """Map allocation with the default countries, on regions that they list (and one that they do not)."""
    df = relabelled(sales_view(spark, sf_dir), C.REGION, REGION_RELABEL)
    return rounded(region_country_allocation(df), {"sales": 4})


oracle(
    "allocation_default_hits",
    with_sales(
        f"r AS (SELECT {_relabel_sql('region', REGION_RELABEL)} AS region, {total('sales_revenue')} AS rev FROM sales GROUP BY 1)",
        "c AS (SELECT region, rev, CASE region "
        + " ".join(f"WHEN '{r}' THEN [{', '.join(repr(x) for x in cs)}]" for r, cs in C.DEFAULT_REGION_COUNTRIES.items())
        + " ELSE ['USA'] END AS countries FROM r)",
    )
    + f"SELECT unnest(countries) AS country, region, {half_up('rev / len(countries)', 4)} AS sales FROM c",
)


@query("dashboard_filtered")
def q_dashboard_filtered(spark, sf_dir):
    """The dashboard's flow: map a raw export, add calendar features, filter, and show KPIs by widget."""
    raw = raw_renamed_frame(spark, sf_dir, percent_discount=True)
    chosen = D.apply_filters(D.prepare(raw), RANGE_START, RANGE_END, ISIN_SELECTIONS)
    return rounded(D.dashboard(chosen)["kpis"], KPIS)


oracle(
    "dashboard_filtered",
    with_sales(
        f"""f AS (SELECT * FROM sales WHERE date >= TIMESTAMP '{RANGE_START}' AND date < TIMESTAMP '{RANGE_END}' + INTERVAL 1 DAY
       AND region IN ('ASIA', 'EUROPE') AND product_category IN ('PROMO', 'STANDARD', 'SMALL'))"""
    )
    + f"""SELECT {half_up(total('sales_revenue'))} AS total_revenue, SUM(units_sold) AS total_units,
       ROUND(AVG(discount) * 100, 6) AS avg_discount_pct, ROUND({total('sales_revenue')} / COUNT(*), 2) AS avg_order_value,
       COUNT(*) AS row_count FROM f""",
)


# ---------------------------------------------------------------------------
# Stored sales: layout, buckets, facts
# ---------------------------------------------------------------------------
@query("sales_view_bucketed")
def q_sales_view_bucketed(spark, sf_dir):
    """The sales view from sources that are bucketed by the order key."""
    return sales_view_bucketed(spark, sf_dir, bucket_sources(spark, sf_dir))


oracle("sales_view_bucketed", with_sales() + "SELECT * FROM sales")


@query("layout_kpis")
def q_layout_kpis(spark, sf_dir):
    """KPIs of a date range from the written layout: no join, and only the months asked for are read."""
    return rounded(A.kpi_summary(read_layout(spark, stored_sales(spark, sf_dir), RANGE_START, RANGE_END)), KPIS)


oracle(
    "layout_kpis",
    with_sales(f"f AS (SELECT * FROM sales WHERE date >= TIMESTAMP '{RANGE_START}' AND date < TIMESTAMP '{RANGE_END}' + INTERVAL 1 DAY)")
    + f"""SELECT {half_up(total('sales_revenue'))} AS total_revenue, SUM(units_sold) AS total_units,
       ROUND(AVG(discount) * 100, 6) AS avg_discount_pct, ROUND({total('sales_revenue')} / COUNT(*), 2) AS avg_order_value,
       COUNT(*) AS row_count FROM f""",
)


@query("facts_kpis")
def q_facts_kpis(spark, sf_dir):
    """KPIs by category from facts that were loaded in two steps, the second reading only what came since."""
    folder, path = work_dir(spark, "facts-source") + "/sales", work_dir(spark, "facts-store")
    store = FactStore(spark, path, folder, lambda files: spark.read.parquet(*files))
    rows = sales_view(spark, sf_dir)
    for step in (F.month(C.DATE) <= 6, F.month(C.DATE) > 6):
        rows.filter(step).write.mode("append").parquet(folder)
        store.refresh()
    return rounded(A.category_summary_from(store.facts()), {"total_revenue": 2, "avg_price": 6, "avg_discount_pct": 6})


oracle(
    "facts_kpis",
    with_sales()
    + f"""SELECT product_category, {half_up(total('sales_revenue'))} AS total_revenue, SUM(units_sold) AS total_units,
       ROUND(AVG(price_per_unit), 6) AS avg_price, ROUND(AVG(discount) * 100, 6) AS avg_discount_pct
FROM sales WHERE product_category IS NOT NULL GROUP BY product_category""",
)
