"""Guarded arithmetic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, or `default` when den is 0 or NULL (ANSI mode raises on x/0)."""
    return F.coalesce(F.try_divide(num, den), F.lit(default))
