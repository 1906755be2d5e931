"""Order-independent sums of measures.

A sum of doubles depends on the order in which rows are added, so the same
query could give other last digits on another partitioning.  Each value is
therefore split: its whole micro-units are summed exactly as a decimal, and
what is left below a micro-unit (nothing, for prices in cents times discount
fractions) is summed as a double.  No digit is dropped: values below a cent,
ratios and very large numbers add up like any others.  Nothing is rounded
here; presentation rounds.

Values that do not fit the exact part (above about 9e12, or infinite) go to
the double part whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
#: Largest value whose micro-units fit a long.
EXACT_LIMIT = 9.0e12


def money_sum(col: Column | str) -> Column:
    """sum() of a measure as double, the same for any order of rows.

    An empty or all-null group gives 0.0 (pandas semantics), not null.  NaN
    counts as null.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    fits = F.abs(c) < EXACT_LIMIT
    # A bigint widened to decimal(20,0) keeps the sum a compact decimal while it fits.
    micros = F.when(fits, F.rint(c * float(MICROS))).cast("bigint")
    rest = F.when(fits, c - micros.cast("double") / float(MICROS)).otherwise(c)
    exact = F.coalesce(F.sum(micros.cast("decimal(20,0)")).cast("double") / float(MICROS), F.lit(0.0))
    return exact + F.coalesce(F.sum(rest), F.lit(0.0))
