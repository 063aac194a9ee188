"""Column expressions for standardisation and time shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import _c


def zscore(c, mean: float, std: float) -> Column:
    """(c - mean) / std; a zero or missing std gives null instead of an error."""
    return F.try_divide(_c(c) - F.lit(mean), F.lit(std))


def time_fraction(t, month: int) -> Column:
    """t / month: 1.0 at ``month``, decreasing linearly backwards."""
    return _c(t).cast("double") / F.lit(float(month))


def next_calendar_month(month: int) -> int:
    return month % 12 + 1


def circular_month(t_month, month: int) -> Column:
    """Closeness of a calendar month to the month after ``month``, going round the year.

    1.1 for that month itself, a sixth less for each month of distance in the
    shorter direction, 0.1 for the month opposite.
    """
    distance = F.abs(F.pmod(_c(t_month) - F.lit(next_calendar_month(month)) + 5, F.lit(12)) - 5)
    return F.lit(1.1) - distance / F.lit(6.0)
