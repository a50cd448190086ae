"""Numeric expressions shared by the analyses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients of the error-function polynomial.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("none")


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """(value - mean) / std, and 0 where std is 0."""
    return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(value - mean, std))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value kept within bounds; null stays null (least and greatest alone would skip it) and NaN becomes null."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def confidence_score(value: Column) -> Column:
    return clamp(value.cast("double"), 0.0, 100.0)


def confidence_level(value: Column) -> Column:
    return F.when(value >= 90, "high").when(value >= 70, "medium").when(value >= 50, "low").otherwise("very_low")


def _tail(z: Column, argument: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * argument)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-z * z / 2)


def p_value(z: Column) -> Column:
    """Two-tailed normal p-value (error below 1.5e-7)."""
    size = F.abs(z)
    return _tail(size, size / math.sqrt(2))


def p_value_ref(z: Column) -> Column:
    """The p-value as the original analyses print it: the polynomial is fed z instead of z / sqrt(2)."""
    size = F.abs(z)
    return _tail(size, size)


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation; null where |r| = 1."""
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))
