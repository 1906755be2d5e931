"""Column functions over model-response texts and display formatting.

All are built-in expressions (regexp, JSON, higher-order array functions),
so they run inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revcast import columns as C

INSIGHT_SCHEMA = "array<struct<icon:string,text:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim all leading/trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def strip_fences(c: Column | str) -> Column:
    """Remove a leading ```` ``` ```` / ```` ```json ```` fence and a trailing fence."""
    text = strip_ws(c)
    text = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    text = F.regexp_replace(text, r"\s*```$", "")
    return strip_ws(text)


def mark_currency(c: Column | str) -> Column:
    """Wrap dollar amounts such as ``$1,234``, ``$5.2M`` in a highlight tag."""
    return F.regexp_replace(_col(c), C.CURRENCY_PATTERN, C.CURRENCY_MARKUP.format("$0"))


def parse_insights(c: Column | str, max_items: int = C.MAX_INSIGHTS) -> Column:
    """Response text -> ``array<struct<icon, text>>``: fences stripped, JSON
    array parsed (malformed -> null), first ``max_items`` items kept, missing
    icon defaulted, blank texts dropped, dollar amounts marked up."""
    parsed = F.from_json(strip_fences(c), INSIGHT_SCHEMA)
    first = F.slice(parsed, 1, max_items)
    cleaned = F.transform(
        first,
        lambda item: F.struct(
            F.coalesce(item["icon"], F.lit(C.DEFAULT_ICON)).alias("icon"),
            strip_ws(F.coalesce(item["text"], F.lit(""))).alias("text"),
        ),
    )
    kept = F.filter(cleaned, lambda item: item["text"] != F.lit(""))
    return F.transform(kept, lambda item: F.struct(item["icon"].alias("icon"), mark_currency(item["text"]).alias("text")))


def money_text(c: Column | str, decimals: int = 2) -> Column:
    """``$1,234.56``"""
    return F.concat(F.lit("$"), F.format_number(_col(c), decimals))


def thousands(c: Column | str) -> Column:
    """``1,234`` for whole numbers."""
    return F.format_number(_col(c).cast("bigint"), 0)


def percent_text(c: Column | str, decimals: int = 1, signed: bool = False) -> Column:
    fmt = f"%{'+' if signed else ''}.{decimals}f%%"
    return F.format_string(fmt, _col(c))


def month_year(c: Column | str) -> Column:
    """``January 2024``"""
    return F.date_format(_col(c), "MMMM yyyy")


def title_case(name: str) -> str:
    """Column name for display: ``product_category`` -> ``Product Category``."""
    return name.replace("_", " ").title()
