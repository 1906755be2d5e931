"""Period labels and steps for resampling.

Labels follow pandas' anchored offsets: a day is labelled by its midnight, a
week by the Sunday that ends it (``'W'`` = ``'W-SUN'``), a month by its last
day (``'ME'``).  Labels are ``timestamp_ntz`` at midnight.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("D", "W", "ME")
_ALIASES = {"D": "D", "DAY": "D", "W": "W", "WEEK": "W", "W-SUN": "W", "ME": "ME", "M": "ME", "MONTH": "ME"}


def normalise_freq(freq: str) -> str:
    try:
        return _ALIASES[freq.upper()]
    except KeyError as exc:
        raise ValueError(f"Unsupported frequency {freq!r}; use one of {FREQUENCIES}") from exc


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_end(ts: Column | str, freq: str) -> Column:
    """Label of the period containing ``ts`` (midnight ``timestamp_ntz``)."""
    freq = normalise_freq(freq)
    day = F.to_date(_as_col(ts))
    if freq == "D":
        label = day
    elif freq == "W":
        # next_day is strictly after, so step back one day first: a Sunday
        # labels itself.
        label = F.next_day(F.date_sub(day, 1), "SUN")
    else:
        label = F.last_day(day)
    return label.cast("timestamp_ntz")


def step_periods(label: Column | str, n: Column | int, freq: str) -> Column:
    """The label ``n`` periods after ``label`` (``n`` may be negative)."""
    freq = normalise_freq(freq)
    day = F.to_date(_as_col(label))
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    if freq == "D":
        out = F.date_add(day, n_col)
    elif freq == "W":
        out = F.date_add(day, n_col * 7)
    else:
        out = F.last_day(F.add_months(day, n_col))
    return out.cast("timestamp_ntz")


def periods_between(start: Column | str, end: Column | str, freq: str) -> Column:
    """Number of whole periods from label ``start`` to label ``end``."""
    freq = normalise_freq(freq)
    s, e = F.to_date(_as_col(start)), F.to_date(_as_col(end))
    if freq == "D":
        return F.datediff(e, s)
    if freq == "W":
        return (F.datediff(e, s) / 7).cast("int")
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("int")


def day_index(ts: Column | str, origin: Column | str) -> Column:
    """Whole days from ``origin`` to ``ts`` (the trend regressor)."""
    return F.datediff(F.to_date(_as_col(ts)), F.to_date(_as_col(origin)))
