"""Scalar and aggregate column expressions shared by the operators.

Money is summed exactly at eight decimals and only the result is rounded, so
prices below a cent are not lost. A row adds its whole units to a long and its
fraction, as a whole number of 1e-8, to a DECIMAL; the two sums meet in a
DECIMAL(28,8). The sum is independent of summation order, so results are
reproducible across partitionings and equal to a SQL engine summing decimals of
eight places. Whole numbers avoid the slow double -> decimal cast per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,8)"
FRACTIONS = 100_000_000  # parts of a unit of money that a sum keeps


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_total(c) -> Column:
    """Exact sum of a money column as DECIMAL(28,8) (for shares and running sums)."""
    whole = F.floor(_c(c))
    part = F.rint((_c(c) - whole) * FRACTIONS).cast("long").cast("decimal(18,0)")
    parts = F.sum(part) * F.lit("0.00000001").cast("decimal(8,8)")
    return (F.sum(whole).cast(MONEY) + parts.cast(MONEY)).cast(MONEY)


def money_double(total) -> Column:
    """A money total as a double amount (correctly rounded)."""
    return _c(total).cast("double")


def money_sum(c) -> Column:
    """Exact sum of a money column, as double."""
    return money_double(money_total(c))


def ratio(num, den) -> Column:
    """num / den as double; null when den is 0 (safe under ANSI mode)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def month_start(c) -> Column:
    """First day of the month of a date."""
    return F.trunc(_c(c), "MM")


def month_key(c) -> Column:
    """Month as text ``YYYY-MM``."""
    return F.date_format(_c(c), "yyyy-MM")


def months_between_starts(later, earlier) -> Column:
    """Whole months between the months of two dates (later - earlier)."""
    return ((F.year(_c(later)) - F.year(_c(earlier))) * 12
            + (F.month(_c(later)) - F.month(_c(earlier))))


def quarter_label(c) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_c(c)).cast("string"))


def truncate_label(c, max_len: int, keep: int) -> Column:
    """Text longer than ``max_len`` cut to ``keep`` characters plus an ellipsis."""
    col = _c(c)
    return F.when(F.length(col) > max_len, F.concat(F.substring(col, 1, keep), F.lit("…"))).otherwise(col)
