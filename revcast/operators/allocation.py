"""Region -> country allocation for the map view.

Each region's revenue is split equally over the countries listed for it; a
region without an entry goes to the default list.  The region table is a
parameter: a Python mapping becomes a map literal (no join); a DataFrame
``(region, country)`` is grouped to one array per region and joined -
broadcast only when its measured bytes are under a limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C
from revcast.operators.aggregates import revenue_by_region
from revcast.operators.profit import broadcast_if_small


def _array_map(mapping: Mapping[str, Sequence[str]]):
    items = []
    for region, countries in mapping.items():
        items += [F.lit(region), F.array(*[F.lit(c) for c in countries])]
    return F.create_map(*items)


def region_country_allocation(
    df: DataFrame,
    countries: Mapping[str, Sequence[str]] | DataFrame | None = None,
    default: Sequence[str] = tuple(C.UNKNOWN_REGION_COUNTRIES),
    region_col: str = C.REGION,
) -> DataFrame:
    """``(country, region, sales)``: region revenue divided over its countries."""
    countries = C.DEFAULT_REGION_COUNTRIES if countries is None else countries
    regions = revenue_by_region(df, region_col)
    fallback = F.array(*[F.lit(c) for c in default])
    if isinstance(countries, Mapping):
        listed = F.try_element_at(_array_map(countries), F.col(region_col))
        with_list = regions.withColumn("__countries", F.coalesce(listed, fallback))
    else:
        lists = countries.groupBy(F.col("region").alias("__r")).agg(
            F.array_sort(F.collect_set("country")).alias("__list")
        )
        size = F.octet_length("__r") + F.aggregate("__list", F.lit(16), lambda a, c: a + F.octet_length(c) + 8)
        lists = broadcast_if_small(lists, F.coalesce(size, F.lit(16)))
        with_list = regions.join(lists, regions[region_col] == lists["__r"], "left").withColumn(
            "__countries", F.coalesce(F.col("__list"), fallback)
        )
    return with_list.select(
        F.explode("__countries").alias("country"),
        F.col(region_col).alias("region"),
        (F.col(C.REVENUE) / F.size("__countries")).alias("sales"),
    )
