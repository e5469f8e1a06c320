"""Small numeric expressions shared by metrics and scorers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double, 0 when the denominator is 0."""
    num, den = numerator.cast("double"), denominator.cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def rounded(column: Column, digits: int = 6) -> Column:
    """Round, and turn negative zero into zero so equal values have one form."""
    return F.round(column, digits) + F.lit(0.0)


def dot(columns: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> Column:
    """bias + sum of weight times column, as one code-generated expression."""
    if len(columns) != len(weights):
        raise ValueError("one weight per column is required")
    terms = (F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(columns, weights))
    return reduce(lambda left, right: left + right, terms, F.lit(float(bias)))
