"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division giving null for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part * 100.0, whole)


def skew_adjusted(c: Column) -> Column:
    """Bias-corrected skewness; Spark's own is the population form."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis_adjusted(c: Column) -> Column:
    """Bias-corrected excess kurtosis; Spark's own is the population excess."""
    n = F.count(c).cast("double")
    scale = ratio(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(c) + 6))
