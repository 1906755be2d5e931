"""Calendar features of the sale date (narrow, codegen'd projections)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import columns as C


def engineer_features(df: DataFrame, date_col: str = C.DATE) -> DataFrame:
    """Add year, month, quarter, day_of_week (Monday = 0), is_weekend,
    month_name (``Jan``) and day_of_year."""
    d = F.col(date_col)
    dow = F.weekday(d)
    return df.withColumns(
        {
            C.YEAR: F.year(d),
            C.MONTH: F.month(d),
            C.QUARTER: F.quarter(d),
            C.DAY_OF_WEEK: dow,
            C.IS_WEEKEND: dow.isin(5, 6).cast("int"),
            C.MONTH_NAME: F.date_format(d, "MMM"),
            C.DAY_OF_YEAR: F.dayofyear(d),
        }
    )
