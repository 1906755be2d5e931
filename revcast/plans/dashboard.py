"""The dashboard flow as lazy DataFrames: map -> features -> filter -> facts.

``prepare`` maps a raw table to the canonical schema and adds calendar
features; ``apply_filters`` applies the date range and membership filters
on source columns (so they reach the scan); ``dashboard`` gives every
widget's frame when it is asked for.  The filtered rows are aggregated once, to one row per month,
region, category and product; that frame is checkpointed and every widget but
the two that show single rows is derived from it.  No transactions are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.functions.periods import period_end
from revcast.operators import aggregates as A
from revcast.operators import filters as FL
from revcast.operators.allocation import region_country_allocation
from revcast.operators.calendar import engineer_features
from revcast.operators.periods import sales_trend
from revcast.operators.sampling import explorer_page, price_volume_sample
from revcast.session import materialize
from revcast.sources.mapping import map_and_clean, suggest_mappings


def prepare(raw: DataFrame, date_col: str | None = None, sales_col: str | None = None, **known) -> DataFrame:
    """Mapped rows with calendar features; ``known`` is passed to ``map_and_clean``."""
    guess_date, guess_sales = suggest_mappings(raw)
    return engineer_features(map_and_clean(raw, date_col or guess_date, sales_col or guess_sales, **known))


def apply_filters(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    selections: Mapping[str, list] | None = None,
) -> DataFrame:
    out = df
    if start is not None or end is not None:
        bounds = FL.date_bounds(df).first() if start is None or end is None else None
        out = FL.filter_date_range(out, start or bounds["min_date"].date(), end or bounds["max_date"].date())
    return FL.filter_isin(out, selections or {})


def choose_column(df: DataFrame, wanted: str, place: int = 0) -> str | None:
    """``wanted`` if the frame has it, else the categorical column at ``place`` (or the first), else none."""
    if wanted in df.columns:
        return wanted
    others = FL.categorical_columns(df)
    return others[min(place, len(others) - 1)] if others else None


def facts(df: DataFrame) -> DataFrame:
    """``sales_facts`` per month (labelled by its last day), region, category and product."""
    month = F.when(F.col(C.DATE).isNotNull(), period_end(C.DATE, "ME"))
    per_month = A.sales_facts(df.withColumn("__month", month), "__month", C.REGION, C.CATEGORY, C.PRODUCT)
    return materialize(
        per_month.withColumnRenamed("__month", C.DATE)
        .withColumn(C.YEAR, F.year(C.DATE))
        .withColumn(C.DISCOUNT, F.try_divide("__disc", "__discs"))
    )


class Widgets(Mapping):
    """The widgets' frames by name.  A frame is built when it is first asked for, and the
    pre-aggregate behind most of them when the first of these is; the rest costs nothing."""

    def __init__(self, df: DataFrame, drilldown: str | None = None, pre: DataFrame | None = None):
        self._df, self._pre, self._built = df, pre, {}
        self._builders: dict[str, Callable[[], DataFrame]] = {
            "kpis": lambda: A.kpi_summary_from(self.facts),
            "yoy": lambda: A.yoy_growth_from(self.facts),
            "trend": lambda: sales_trend(self.facts),
            "region_map": lambda: region_country_allocation(self.facts),
            "revenue_by_category": lambda: A.revenue_by_category(self.facts),
            "category_share": lambda: A.category_share(self.facts),
            "category_summary": lambda: A.category_summary_from(self.facts),
            "price_volume": lambda: price_volume_sample(self._df),
            "explorer": lambda: explorer_page(self._df),
        }
        if drilldown is not None:
            self._builders["drilldown"] = lambda: A.product_drilldown(self.facts, drilldown)

    @property
    def facts(self) -> DataFrame:
        if self._pre is None:
            self._pre = facts(self._df)
        return self._pre

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def dashboard(df: DataFrame, drilldown: str | None = None, pre: DataFrame | None = None) -> Widgets:
    """Every widget's data for an already filtered sales frame, each built on demand; ``pre``
    are facts that are there already (``facts``, or those of a ``FactStore``)."""
    return Widgets(df, drilldown, pre)


__all__ = ["prepare", "apply_filters", "choose_column", "facts", "dashboard"]
