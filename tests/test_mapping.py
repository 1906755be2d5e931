"""Schema mapping, type repair and defaults (literal frames)."""

from __future__ import annotations

import datetime as dt

import pytest

from revcast import columns as C
from revcast.sources.mapping import clean_data, map_and_clean, suggest_mappings

RAW_COLS = ["Date", "Product_Category", "Product", "Region", "Units_Sold", "Price_Per_Unit", "Discount", "Sales_Revenue"]


def raw_rows():
    return [
        ("2024-01-01", "Electronics", "Laptop Pro", "North", "2", "1299.99", "0.1", "2339.98"),
        ("2024-01-02", "Wearables", "Smart Watch", "East", "1", "299.99", "0.0", "299.99"),
        ("not a date", "Others", "Water Bottle", "West", "3", "34.99", "0.05", "99.72"),
        ("2024-01-03", "Mystery", "Thing", "South", "abc", "10.0", "0.0", "20.0"),
    ]


def test_clean_data_renames_repairs_and_drops_bad_dates(spark):
    df = spark.createDataFrame(raw_rows(), RAW_COLS)
    out = clean_data(df)
    assert out.columns[:8] == C.SALES_COLUMNS
    rows = {r[C.PRODUCT]: r for r in out.collect()}
    assert "Water Bottle" not in rows  # unparseable date dropped
    assert rows["Thing"][C.UNITS] == 0.0  # junk number -> 0
    assert rows["Laptop Pro"][C.DATE] == dt.datetime(2024, 1, 1)
    assert rows["Laptop Pro"][C.MARGIN] == pytest.approx(0.2134)
    assert rows["Thing"][C.MARGIN] == pytest.approx(0.22)  # unknown category
    assert rows["Smart Watch"][C.PROFIT] == pytest.approx(299.99 * 0.32)


def test_clean_data_case_and_space_insensitive_names(spark):
    cols = ["date", "Product Category", "PRODUCT", "region", "Units Sold", "price_per_unit", "Discount", "Sales Revenue"]
    df = spark.createDataFrame(raw_rows()[:2], cols)
    assert clean_data(df).count() == 2


def test_clean_data_missing_column_raises(spark):
    df = spark.createDataFrame([("2024-01-01", "x")], ["Date", "Product"])
    with pytest.raises(ValueError, match="Missing required column"):
        clean_data(df)


def test_clean_data_defaults_discount_and_derives_revenue(spark):
    cols = ["Date", "Product_Category", "Product", "Region", "Units_Sold", "Price_Per_Unit"]
    df = spark.createDataFrame([("2024-01-01", "Accessories", "Case", "North", 4.0, 10.0)], cols)
    row = clean_data(df).first()
    assert row[C.DISCOUNT] == 0.0
    assert row[C.REVENUE] == pytest.approx(40.0)
    assert row[C.PROFIT] == pytest.approx(40.0 * 0.25)


def test_suggest_mappings_renamed_columns(spark):
    cols = ["transaction_time", "Product_Category", "Product", "Region", "Units_Sold", "Price_Per_Unit", "Discount",
            "net_revenue_usd"]
    df = spark.createDataFrame(raw_rows()[:1], cols)
    assert suggest_mappings(df) == ("transaction_time", "net_revenue_usd")


def test_suggest_mappings_prefers_temporal_type_and_numeric_fallback(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 5.0)], ["id", "when", "value"])
    date_col, sales_col = suggest_mappings(df)
    assert date_col == "when"
    assert sales_col == "id"  # first numeric column that is not the date


def test_map_and_clean_rules_defaults_and_percent(spark):
    rows = [
        ("2024-01-05", "Widget", "Tools", 2.0, 10.0, 12.5, 25.0, None),
        ("2024-01-06", None, "Tools", None, 20.0, None, 20.0, "North"),
        ("junk", "Widget", "Tools", 1.0, 0.0, 5.0, 5.0, "North"),
    ]
    cols = ["order_date", "item_name", "dept", "qty", "discount_pct", "unit_price", "amount", "sales_territory"]
    df = spark.createDataFrame(rows, cols)
    out = map_and_clean(df, "order_date", "amount")
    got = sorted(out.collect(), key=lambda r: r[C.DATE])
    assert len(got) == 2
    first, second = got
    assert first[C.DISCOUNT] == pytest.approx(0.10)  # max 20 > 1 -> percent
    assert second[C.UNITS] == 1.0  # null units -> 1
    assert second[C.PRICE] == 20.0  # null price -> revenue
    assert first[C.REGION] == C.DEFAULT_REGION  # null -> Global
    assert second[C.PRODUCT] == C.DEFAULT_PRODUCT  # null -> Standard Product
    assert first[C.CATEGORY] == "Tools"


def test_map_and_clean_rate_quirk_skips_used_column(spark):
    cols = ["date", "discount_rate", "unit_price", "sales"]
    df = spark.createDataFrame([("2024-01-01", 0.1, 9.0, 18.0)], cols)
    row = map_and_clean(df, "date", "sales").first()
    assert row[C.DISCOUNT] == pytest.approx(0.1)
    assert row[C.PRICE] == 9.0


def test_map_and_clean_absent_columns_get_defaults(spark):
    df = spark.createDataFrame([("2024-03-01", 50.0)], ["day", "revenue"])
    row = map_and_clean(df, "day", "revenue").first()
    assert (row[C.UNITS], row[C.DISCOUNT], row[C.PRICE]) == (1.0, 0.0, 50.0)
    assert (row[C.REGION], row[C.CATEGORY], row[C.PRODUCT]) == ("Global", "General", "Standard Product")
    assert row[C.MARGIN] == pytest.approx(0.22)  # product_category column exists, value unknown


def test_map_and_clean_errors(spark):
    df = spark.createDataFrame([("2024-03-01", 50.0)], ["day", "revenue"])
    with pytest.raises(ValueError):
        map_and_clean(df, "missing", "revenue")
    with pytest.raises(ValueError):
        map_and_clean(df, "revenue", "revenue")


def test_timestamp_offsets_normalise_to_utc(spark):
    df = spark.createDataFrame([("2024-01-01T23:30:00+02:00", 1.0), ("01/02/2024", 2.0)], ["ts", "sales"])
    got = sorted(r[C.DATE] for r in map_and_clean(df, "ts", "sales").collect())
    assert got == [dt.datetime(2024, 1, 1, 21, 30), dt.datetime(2024, 1, 2)]


def test_dotted_and_spaced_raw_names(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 10.0, "x", "Electronics")], ["order.date", "net.revenue", "note.v1", "Product Category"]
    )
    date_col, sales_col = suggest_mappings(df)
    assert (date_col, sales_col) == ("order.date", "net.revenue")
    out = map_and_clean(df, date_col, sales_col)
    row = out.first()
    assert row[C.REVENUE] == 10.0 and row["note.v1"] == "x"
    assert row[C.CATEGORY] == "Electronics" and row[C.MARGIN] == pytest.approx(0.2134)
