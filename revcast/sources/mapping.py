"""Map arbitrary sales tables onto the canonical schema.

Two entry points, as in the modelled application:

* ``clean_data``   - strict: the eight canonical names must be present
  (matched case- and space-insensitively); discount defaults to 0.0 and
  revenue may be derived from units x price x (1 - discount).
* ``map_and_clean`` - lenient: the caller names the date and sales columns
  (``suggest_mappings`` proposes them); every other canonical column is
  found by name rules or gets a default.

Columns are chosen from ``df.schema`` on the driver; the resulting projection
is one narrow ``select``.  Two facts need the data: whether dates in numbers
write the day first, and whether discounts are percents.  Where they matter (a
text date, a discount column) the mapped rows are written once, in one pass over
the source that observes both facts as it goes, and what is returned reads that
table; so nothing reads the source, or parses it, again.  Callers that know the
facts pass ``day_first`` and ``percent``: then no job runs and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revcast import columns as C
from revcast.functions.coerce import (
    day_and_month_swapped,
    day_first_of,
    is_numeric_type,
    is_temporal_type,
    is_text,
    order_written,
    qcol,
    to_double,
    to_label,
    to_timestamp_utc,
)
from revcast.operators.profit import calculate_profit
from revcast.session import write_table

CANONICAL_ORDER = C.SALES_COLUMNS
#: Names that the mapped frame makes itself; an original of the same name gives way.
_OWN_NAMES = {*C.SALES_COLUMNS, C.MARGIN, C.PROFIT}


def normalise_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def _settled(
    raw: DataFrame, date_col: str, columns: list[Column], discount: str | None, day_first: bool | None, percent: bool | None
) -> DataFrame:
    """``columns`` (the date first) of the dated rows of ``raw``, with the order of dates and
    the scale of discounts settled; ``discount`` names the column to scale, if there is one.

    Facts that are not given are observed while the rows are written.
    """
    ask_order = day_first is None and is_text(raw, date_col)
    ask_percent = percent is None and discount is not None
    if not (ask_order or ask_percent):
        out = raw.select(*columns).filter(F.col(C.DATE).isNotNull())
        return out.withColumn(discount, F.col(discount) / 100.0) if percent and discount else out
    marks = dict(zip(("__day", "__month", "__either"), order_written(raw, date_col), strict=True)) if ask_order else {}
    rows = raw.select(*columns, *(m.alias(name) for name, m in marks.items())).filter(F.col(C.DATE).isNotNull())
    facts = Observation()
    asked = [F.count_if(c).alias(c) for c in ("__day", "__month") if ask_order] + ([F.max(discount).alias("peak")] if ask_percent else [])
    rows = write_table(rows.observe(facts, *asked).drop("__day", "__month"), "mapped")
    seen = facts.get
    if ask_order:
        if day_first_of(seen["__day"], seen["__month"]):
            date = F.when(F.col("__either"), day_and_month_swapped(F.col(C.DATE))).otherwise(F.col(C.DATE))
            rows = rows.withColumn(C.DATE, date)
        rows = rows.drop("__either")
    if percent if not ask_percent else (seen["peak"] or 0.0) > 1.0:
        rows = rows.withColumn(discount, F.col(discount) / 100.0)
    return rows


def undated_rows(df: DataFrame, date_col: str, day_first: bool = False) -> DataFrame:
    """``n_rows, n_undated``: how many rows a mapping drops because their date is not readable."""
    date = to_timestamp_utc(df, date_col, day_first)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(date.isNull()).alias("n_undated"))


# ---------------------------------------------------------------------------
# Strict cleaning
# ---------------------------------------------------------------------------
def clean_data(df: DataFrame, margins=None, day_first: bool | None = None) -> DataFrame:
    """Canonical names and types, undated rows dropped, profit added.

    A column whose name only differs by case or spaces from a canonical one is
    taken for it, the last such column if there are several; others stay behind
    the canonical ones.  Raises ``ValueError`` naming all that is missing.
    """
    source = {normalise_name(name): name for name in df.columns}
    derivable = {C.DISCOUNT} | ({C.REVENUE} if {C.UNITS, C.PRICE} <= source.keys() else set())
    lacking = [c for c in C.SALES_COLUMNS if c not in source and c not in derivable]
    if lacking:
        raise ValueError(f"Missing required column(s): {', '.join(c.title() for c in lacking)}")

    number = {c: to_double(df, source[c]) for c in C.NUMERIC_COLUMNS if c in source}
    number.setdefault(C.DISCOUNT, F.lit(0.0))
    number.setdefault(C.REVENUE, number.get(C.UNITS, F.lit(0.0)) * number.get(C.PRICE, F.lit(0.0)) * (1.0 - number[C.DISCOUNT]))
    made = {C.DATE: to_timestamp_utc(df, source[C.DATE], bool(day_first))} | number
    canonical = [made.get(c, qcol(source.get(c, c))).alias(c) for c in CANONICAL_ORDER]
    extras = [qcol(c) for c in df.columns if normalise_name(c) not in _OWN_NAMES]
    # The strict names promise fractions, so discounts are not scaled.
    out = _settled(df, source[C.DATE], [*canonical, *extras], None, day_first, False)
    return calculate_profit(out, margins=margins)


# ---------------------------------------------------------------------------
# Column suggestions
# ---------------------------------------------------------------------------
Rank = tuple[int, int]


def _keyword_rank(keywords: list[str], match: Callable[[str, str], bool], tier: int) -> Callable[[T.StructField], Rank | None]:
    """Ranks a field by the first keyword that its lower-cased name matches."""

    def rank(field: T.StructField) -> Rank | None:
        place = next((k for k, word in enumerate(keywords) if match(word, field.name.lower())), None)
        return None if place is None else (tier, place)

    return rank


def _best(fields: Iterable[T.StructField], rules: list[Callable[[T.StructField], Rank | None]]) -> str | None:
    """The field with the lowest rank under any rule; the leftmost of equals."""
    ranked = [(min(r), k, f.name) for k, f in enumerate(fields) if (r := [x for rule in rules if (x := rule(f)) is not None])]
    return min(ranked)[2] if ranked else None


def suggest_mappings(df: DataFrame) -> tuple[str | None, str | None]:
    """Propose ``(date_column, sales_column)`` by ranking every field.

    Date: date-typed fields, then names that contain a date keyword (in the
    keywords' order), then any field.  Sales: names that are a sales keyword,
    then names that contain one, then numbers other than the date, then the
    second field, then the first.
    """
    fields = df.schema.fields
    date = _best(
        fields,
        [
            lambda f: (0, 0) if is_temporal_type(f.dataType) else None,
            _keyword_rank(C.DATE_KEYWORDS, lambda word, name: word in name, 1),
            lambda f: (2, 0),
        ],
    )
    by_place = [f.name for f in (fields[1:2] + fields[:1]) if f.name != date or len(fields) == 1] or [date]
    sales = _best(
        fields,
        [
            _keyword_rank(C.SALES_KEYWORDS, lambda word, name: word == name, 0),
            _keyword_rank(C.SALES_KEYWORDS, lambda word, name: word in name, 1),
            lambda f: (2, 0) if f.name != date and is_numeric_type(f.dataType) else None,
            lambda f: (3, by_place.index(f.name)) if f.name in by_place else None,
        ],
    )
    return date, sales


# ---------------------------------------------------------------------------
# Lenient mapping
# ---------------------------------------------------------------------------
def _find(cols: list[str], used: set[str], exact: list[str], substrings: list[str]) -> str | None:
    """First unused column equal to an ``exact`` name, else containing a substring."""
    candidates = [c for c in cols if c not in used]
    for name in candidates:
        if name.lower() in exact:
            return name
    for name in candidates:
        low = name.lower()
        if any(s in low for s in substrings):
            return name
    return None


def map_and_clean(
    df: DataFrame,
    date_col: str,
    sales_col: str,
    margins=None,
    day_first: bool | None = None,
    percent: bool | None = None,
) -> DataFrame:
    """Canonical sales frame from any table, given its date and sales columns.

    Columns used as a source of a canonical column are replaced by it; others
    are kept after the canonical ones, but for those whose name (in any case) is
    one that the mapped frame makes, which give way to it, and for repeats of a
    name that only differ by case.  Rules (first unused match in column order):
    units ~ units|qty|quantity (null -> 1, absent -> 1); discount ~ discount
    (null -> 0; the whole column is divided by 100 when its maximum exceeds 1,
    or as ``percent`` says); price ~ price|rate (null/absent -> revenue);
    region, category and product by exact name lists, then substrings
    (null/absent -> 'Global', 'General', 'Standard Product').
    """
    if not {date_col, sales_col} <= set(df.columns):
        raise ValueError(f"No such column: {', '.join(sorted({date_col, sales_col} - set(df.columns)))}")
    if date_col == sales_col:
        raise ValueError(f"One column ({date_col}) cannot be both date and sales.")

    # Positions as names, so that names that differ by case alone stay apart.
    cols = list(df.columns)
    inner = {name: f"c{k}" for k, name in enumerate(cols)}
    raw = df.toDF(*(f"c{k}" for k in range(len(cols))))
    used = {date_col, sales_col}

    def source(exact: list[str], substrings: list[str]) -> str | None:
        found = _find(cols, used, exact, substrings)
        used.update([found] if found else [])
        return inner[found] if found else None

    units_src = source([], C.UNITS_SUBSTRINGS)
    discount_src = source([], C.DISCOUNT_SUBSTRINGS)
    price_src = source([], C.PRICE_SUBSTRINGS)
    labels = {
        C.REGION: (source(C.REGION_EXACT, C.REGION_SUBSTRINGS), C.DEFAULT_REGION),
        C.CATEGORY: (source(C.CATEGORY_EXACT, C.CATEGORY_SUBSTRINGS), C.DEFAULT_CATEGORY),
        C.PRODUCT: (source(C.PRODUCT_EXACT, C.PRODUCT_SUBSTRINGS), C.DEFAULT_PRODUCT),
    }

    discount = to_double(raw, discount_src) if discount_src else F.lit(0.0)
    revenue = to_double(raw, inner[sales_col])
    seen = set(_OWN_NAMES)
    extras = []
    for name in cols:
        if name not in used and name.lower() not in seen:
            seen.add(name.lower())
            extras.append(qcol(inner[name]).alias(name))
    columns = [
        to_timestamp_utc(raw, inner[date_col], bool(day_first)).alias(C.DATE),
        *(
            (to_label(raw, labels[c][0], labels[c][1]) if labels[c][0] else F.lit(labels[c][1])).alias(c)
            for c in (C.CATEGORY, C.PRODUCT, C.REGION)
        ),
        (to_double(raw, units_src, 1.0) if units_src else F.lit(1.0)).alias(C.UNITS),
        (to_double(raw, price_src, revenue) if price_src else revenue).alias(C.PRICE),
        discount.alias(C.DISCOUNT),
        revenue.alias(C.REVENUE),
        *extras,
    ]
    mapped = _settled(raw, inner[date_col], columns, C.DISCOUNT if discount_src else None, day_first, percent)
    return calculate_profit(mapped, margins=margins)
