"""Missing-value rules. A value is either finite or NULL; NaN and infinities never travel on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column, default: float | None = None) -> Column:
    """``c`` as a double, with NaN and infinities (and NULL, if a default is given) replaced."""
    value = as_col(c).cast("double")
    cleaned = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return cleaned if default is None else F.coalesce(cleaned, F.lit(float(default)))


def clip(c: str | Column, low: float, high: float) -> Column:
    """``c`` limited to [low, high]; NULL stays NULL (``greatest`` and ``least`` alone would skip it)."""
    value = as_col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of an error or an infinity."""
    return F.try_divide(numerator, F.nullif(denominator, F.lit(0.0)))


def safe_ratio(numerator: Column, denominator: Column, eps: float = 1e-12) -> Column:
    """``numerator/denominator`` where the denominator exceeds ``eps`` and 0 elsewhere."""
    return F.when(denominator > eps, numerator / denominator).otherwise(F.lit(0.0))
