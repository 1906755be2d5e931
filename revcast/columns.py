"""Canonical column names and the fixed values the modelled application uses.

Canonical names are snake_case versions of the application's display names.
"""

from __future__ import annotations

DATE = "date"
CATEGORY = "product_category"
PRODUCT = "product"
REGION = "region"
UNITS = "units_sold"
PRICE = "price_per_unit"
DISCOUNT = "discount"
REVENUE = "sales_revenue"
MARGIN = "profit_margin"
PROFIT = "total_profit"

SALES_COLUMNS = [DATE, CATEGORY, PRODUCT, REGION, UNITS, PRICE, DISCOUNT, REVENUE]
NUMERIC_COLUMNS = [UNITS, PRICE, DISCOUNT, REVENUE]
KEY_COLUMNS = [REGION, CATEGORY, PRODUCT]

YEAR = "year"
MONTH = "month"
QUARTER = "quarter"
DAY_OF_WEEK = "day_of_week"
IS_WEEKEND = "is_weekend"
MONTH_NAME = "month_name"
DAY_OF_YEAR = "day_of_year"
CALENDAR_COLUMNS = [YEAR, MONTH, QUARTER, DAY_OF_WEEK, IS_WEEKEND, MONTH_NAME, DAY_OF_YEAR]

# Columns never offered as categorical filters (core measures, calendar
# features and the two derived profit columns).
NON_CATEGORICAL = [DATE, REVENUE, UNITS, PRICE, DISCOUNT, MARGIN, PROFIT] + CALENDAR_COLUMNS

# Series (resampled) frame
DS = "ds"

# ---------------------------------------------------------------------------
# Fixed values (must equal the modelled application's for equal results)
# ---------------------------------------------------------------------------
# Profit margin per product category; unknown category -> 0.22; no category
# column at all -> 0.2134.
DEFAULT_MARGINS = {
    "Electronics": 0.2134,
    "Accessories": 0.25,
    "Wearables": 0.32,
    "Home Appliances": 0.18,
    "Others": 0.15,
}
UNKNOWN_CATEGORY_MARGIN = 0.22
NO_CATEGORY_MARGIN = 0.2134

# Region -> ISO-3 country codes for the map view; unknown region -> USA.
DEFAULT_REGION_COUNTRIES = {
    "North": ["USA", "CAN"],
    "East": ["GBR", "DEU", "FRA", "ITA", "ESP"],
    "South": ["BRA", "ARG", "COL", "PER"],
    "West": ["AUS", "JPN", "IND", "CHN"],
}
UNKNOWN_REGION_COUNTRIES = ["USA"]

# Defaults for absent descriptive columns in the mapped schema.
DEFAULT_REGION = "Global"
DEFAULT_CATEGORY = "General"
DEFAULT_PRODUCT = "Standard Product"

# Column-name keywords used by the mapping rules, in search order.
DATE_KEYWORDS = ["date", "time", "timestamp", "ds", "period", "year", "day", "month"]
SALES_KEYWORDS = ["revenue", "sales", "sales_revenue", "amount", "total", "turnover", "sales_amount", "y"]
UNITS_SUBSTRINGS = ["units", "qty", "quantity"]
DISCOUNT_SUBSTRINGS = ["discount"]
PRICE_SUBSTRINGS = ["price", "rate"]
REGION_EXACT = ["region", "country", "territory", "zone", "market", "state"]
REGION_SUBSTRINGS = ["region", "country", "territory"]
CATEGORY_EXACT = ["product_category", "category", "class", "department", "dept"]
CATEGORY_SUBSTRINGS = ["category", "dept", "class"]
PRODUCT_EXACT = ["product", "item", "sku", "product_name"]
PRODUCT_SUBSTRINGS = ["product", "item", "name"]

# Forecasting constants.
MIN_HISTORY_PERIODS = 15      # dashboard guard before any model runs
MIN_CLEAN_ROWS = 6            # regression models need this many feature rows
MAX_HOLDOUT = 6               # holdout = max(1, min(6, int(0.2 * n)))
HOLDOUT_FRACTION = 0.2
DEFAULT_LAGS = [1, 2, 3, 12]
ROLLING_WINDOW = 3
INTERVAL_Z = 1.96
MAX_HORIZON = 12

# Insight-response parsing.
DEFAULT_ICON = "\U0001F4A1"   # light bulb emoji
MAX_INSIGHTS = 4
CURRENCY_PATTERN = r"\$[\d,]+(?:\.\d+)?[KMB]?"
CURRENCY_MARKUP = "<b style='color:#00CC96;'>{}</b>"
