"""Numeric column helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, places: int) -> Column:
    """Round half to even on the double itself, and stay inside generated code."""
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def first_number(*values: Column) -> Column:
    """The first value that is neither null nor NaN, as a double."""
    doubles = [v.cast("double") for v in values]
    return F.coalesce(*[F.when(~F.isnan(d), d) for d in doubles])


def difference(left: Column, right: Column, places: int = 4) -> Column:
    """Null if either side is missing, else the rounded difference."""
    return round_even(first_number(left) - first_number(right), places)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null, not an error, on zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def logit(p: Column) -> Column:
    # fixed values: clamp of the study's logit
    q = clamp(p, 1e-9, 1 - 1e-9)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clamp(value: Column, low: float, high: float) -> Column:
    """Kept within the limits; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def width_of(value: Column, biggest: float) -> Column:
    """Bar width in percent of the largest value a statistic takes, kept within 4 … 100."""
    return clamp(F.rint(value / F.lit(biggest) * F.lit(100.0)), 4.0, 100.0)


def tidy(value: Column) -> Column:
    """A number as shown: ``-`` when absent, no decimals when whole, else at most two."""
    two = round_even(value, 2)
    return (
        F.when(value.isNull(), F.lit("-"))
        .when(value == F.floor(value), F.floor(value).cast("string"))
        .otherwise(two.cast("string"))
    )


def signed(odds: Column) -> Column:
    return F.when(odds > 0, F.concat(F.lit("+"), odds.cast("string"))).otherwise(odds.cast("string"))
