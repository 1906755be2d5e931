"""Type repair that never fails the query.

ANSI mode is on by default in Spark 4, so a plain ``cast`` of bad text
raises.  These helpers use ``try_cast`` / ``try_to_timestamp`` so bad values
become null and then take the caller's default, like pandas'
``errors='coerce'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAIL = r"(?:[ T]+(.+))?$"
_YEAR = r"(\d{4}|\d{2})"
# Day, month and year in numbers, in an order that the column decides: 1/2/2024, 1-2-24, 13.02.2024 10:30.
_NUMBERS = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-]{_YEAR}{_TAIL}"
# The first number can only be the day; the second can only be the day.
_DAY_THEN = rf"^(1[3-9]|[23]\d)[/.\-](\d{{1,2}})[/.\-]{_YEAR}{_TAIL}"
_THEN_DAY = rf"^(\d{{1,2}})[/.\-](1[3-9]|[23]\d)[/.\-]{_YEAR}{_TAIL}"
# Year first: 2024/1/5, 2024.01.05 10:30, 20240105.
_YEAR_FIRST = rf"^(\d{{4}})[/.\-](\d{{1,2}})[/.\-](\d{{1,2}}){_TAIL}"
_RUN = rf"^(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}"
# Month by name: Jan 5, 2024; January 5th 2024; 5 January 2024; 05-Jan-24.
_MONTH_FIRST = rf"(?i)^([a-z]{{3}})[a-z]*\.?[ \-/]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ \-/]+{_YEAR}{_TAIL}"
_DAY_FIRST = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[ \-/]+([a-z]{{3}})[a-z]*\.?,?[ \-/]+{_YEAR}{_TAIL}"
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_CLOCK = r"(?i)^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?\s*([ap]m)?$"
# A plain or scientific decimal number; Spark's own cast also takes 5d, 1f, Infinity and NaN.
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)


def qcol(name: str) -> Column:
    """Column by its exact name (dots or spaces in raw file headers are not paths)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_temporal_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def to_double(df: DataFrame, name: str, default: Column | float | None = 0.0) -> Column:
    """Column ``name`` as double; text that is no decimal number, NaN and infinite
    values become ``default``."""
    dtype = field_type(df, name)
    c = qcol(name)
    if is_numeric_type(dtype):
        value = c.cast("double")
    elif isinstance(dtype, T.BooleanType):
        value = c.cast("int").cast("double")
    else:
        text = F.trim(c.cast("string"))
        value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    # False for NaN (above every number in Spark's order) and both infinities; null stays null.
    value = F.when(F.abs(value) < float("inf"), value)
    if default is None:
        return value
    default_col = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(value, default_col)


def _canonical(text: Column, day_first: bool) -> Column:
    """``@year-month-day clock`` for a text in one of the forms; others stay as they are."""
    by_column = r"@$3-$2-$1 $4" if day_first else r"@$3-$1-$2 $4"
    for pattern, order in (
        (_YEAR_FIRST, r"@$1-$2-$3 $4"),
        (_RUN, r"@$1-$2-$3 $4"),
        (_DAY_THEN, r"@$3-$2-$1 $4"),
        (_THEN_DAY, r"@$3-$1-$2 $4"),
        (_NUMBERS, by_column),
        (_MONTH_FIRST, r"@$3-$1-$2 $4"),
        (_DAY_FIRST, r"@$3-$2-$1 $4"),
    ):
        text = F.regexp_replace(text, pattern, order)
    return text


def _moment(canonical: Column) -> Column:
    """The timestamp of a canonical text; null where it is none, names no day, or its time is not readable."""
    body = F.substring_index(canonical, " ", 1)
    clock = F.trim(F.substring(canonical, F.length(body) + 1, F.length(canonical)))
    part = F.split(F.ltrim(body, F.lit("@")), "-")
    year, month = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    y = year.try_cast("int")
    # Two digits: 69 to 99 are 1969 to 1999, the rest 2000 to 2068.
    y = F.when(F.length(year) == 2, F.when(y >= 69, y + 1900).otherwise(y + 2000)).otherwise(y)
    names = F.create_map(*(F.lit(x) for kv in _MONTHS.items() for x in kv))
    m = F.coalesce(month.try_cast("int"), F.try_element_at(names, F.lower(month)))
    hour = F.regexp_extract(clock, _CLOCK, 1).try_cast("int")
    half = F.lower(F.regexp_extract(clock, _CLOCK, 4))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    seconds = F.coalesce(F.nullif(F.regexp_extract(clock, _CLOCK, 3), F.lit("")), F.lit("0"))
    time = F.when(clock == "", F.lit("00:00:00")).when(
        clock.rlike(_CLOCK), F.format_string("%02d:%s:%s", hour, F.regexp_extract(clock, _CLOCK, 2), seconds)
    )
    day = F.format_string("%04d-%02d-%02d", y, m, F.get(part, F.lit(2)).try_cast("int"))
    return F.when(canonical.startswith("@"), F.try_to_timestamp(F.concat(day, F.lit(" "), time)))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), T.StringType)


def order_written(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """Of a text date in three numbers, whether it can only be read day first, only month
    first, or in both orders.  Whatever reads as ISO is in no order."""
    text = F.trim(qcol(name).cast("string"))
    numbers = ~text.rlike(r"^\d{4}(-|$)") & text.rlike(_NUMBERS)
    first, second = text.rlike(_DAY_THEN), text.rlike(_THEN_DAY)
    return tuple(F.coalesce(numbers & c, F.lit(False)) for c in (first & ~second, second & ~first, ~first & ~second))


def day_first_of(n_day_first: int | None, n_month_first: int | None) -> bool:
    """Whether a column writes the day first: some of its dates can only be read so, and none
    only the other way.  Where both occur, dates that can be read either way are month first."""
    return bool(n_day_first) and not n_month_first


def date_order(df: DataFrame, name: str) -> DataFrame:
    """``n_day_first, n_month_first, n_either``: dates in three numbers by the orders they can be
    read in, so that a caller sees what a column mixes."""
    names = ("n_day_first", "n_month_first", "n_either")
    return df.agg(*(F.count_if(c).alias(n) for n, c in zip(names, order_written(df, name), strict=True)))


def day_and_month_swapped(moment: Column) -> Column:
    """A timestamp whose day, at most 12, is the month and the other way round."""
    return F.make_timestamp_ntz(
        F.year(moment), F.dayofmonth(moment), F.month(moment), F.hour(moment), F.minute(moment), F.date_part(F.lit("SECOND"), moment)
    )


def to_timestamp_utc(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """Column ``name`` as a zone-less UTC timestamp (``timestamp_ntz``).

    Instants are rendered in the session time zone, which the library expects
    to be UTC (as the modelled application parses with ``utc=True``).  Text may
    be ISO-8601 (with an offset it is normalised to UTC), year first with any
    separator, three numbers, or a month by name, each with an optional time of
    day.  Three numbers are read month first unless ``day_first``; a number
    above 12 is the day in either order.  Anything else becomes null.
    """
    dtype = field_type(df, name)
    c = qcol(name)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}(-|$)"), F.try_to_timestamp(text))
    # Other forms only where ISO fails; the inner function has the canonical text computed once.
    other = F.get(F.transform(F.array(_canonical(text, day_first)), _moment), F.lit(0))
    return F.coalesce(iso, other).cast("timestamp_ntz")


def to_label(df: DataFrame, name: str, default: str) -> Column:
    """Column ``name`` as string; null -> ``default``."""
    return F.coalesce(qcol(name).cast("string"), F.lit(default))
