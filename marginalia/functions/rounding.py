"""Rounding and choices among three shares (MA01-MA05, MA13): half-even on the binary value everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LABELS = ("resonate", "contradict", "diverge")


def half_even(x: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null for a zero or null divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def largest_of(r: Column, c: Column, d: Column, labels: tuple[str, str, str] = LABELS) -> Column:
    """Label of the largest share; the first wins a tie; null if any is null."""
    return F.when((r >= c) & (r >= d), labels[0]).when((c >= d) & (c > r), labels[1]).when(d.isNotNull() & (r < d) & (c < d), labels[2])


def to_hundred(r: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Shares rounded to whole numbers that sum to 100: the largest rounded one, the first on a tie, takes the rest."""
    a, b, e = (F.rint(x).cast("int") for x in (r, c, d))
    rest = F.lit(100) - a - b - e
    first = (a >= b) & (a >= e)
    second = ~first & (b >= e)
    return a + F.when(first, rest).otherwise(0), b + F.when(second, rest).otherwise(0), e + F.when(~first & ~second, rest).otherwise(0)
