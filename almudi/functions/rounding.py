"""Exact percentages on whole numbers: no binary fractions until the final division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a - F.pmod(a, b), b).cast("long")


def pct_half_up(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent at two decimals, halves away from zero; 0 if whole <= 0."""
    d = F.when(whole > 0, whole)
    cents = F.signum(part).cast("long") * _div(F.abs(part) * 20000 + d, d * 2)
    return F.coalesce(cents / F.lit(100.0), F.when(part.isNotNull(), F.lit(0.0)))


def pct_half_even(part: Column, whole: Column) -> Column:
    """As ``pct_half_up`` with halves to the even neighbour; null if whole <= 0."""
    d = F.when(whole > 0, whole)
    n = F.abs(part) * 10000
    q, r2 = _div(n, d), F.pmod(n, d) * 2
    up = (r2 > d) | ((r2 == d) & (F.pmod(q, F.lit(2)) == 1))
    return F.signum(part).cast("long") * (q + up.cast("long")) / F.lit(100.0)


def mean_half_up(total: Column, n: Column) -> Column:
    """Mean of non-negative whole numbers, rounded half up to a whole number."""
    return _div(total * 2 + n, n * 2)


def days(micros: Column) -> Column:
    """Whole hundredths of a day of a non-negative duration, rounded half up."""
    return _div(micros * 200 + 86_400_000_000, F.lit(172_800_000_000)) / F.lit(100.0)
