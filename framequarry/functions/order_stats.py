"""Order statistics as the frame-quality definitions take them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1.4826 turns a median absolute deviation into the standard deviation of a normal distribution.
MAD_SIGMA = 1.4826


def upper_median(column: str) -> Column:
    """Element n/2 (from 0) of the sorted values: the upper middle for even n, never an average."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def lower_quartile(column: str) -> Column:
    """Element floor((n - 1) / 4) of the sorted values."""
    return F.expr(f"percentile_disc(0.25) WITHIN GROUP (ORDER BY {column})")


def sorted_quantile(values: Column, q: float) -> Column:
    """Element floor(q (n - 1)) of an array, for a bounded group's values; ``values`` is sorted here."""
    return F.element_at(F.array_sort(values), (F.floor(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def array_median(values: Column) -> Column:
    """Upper median of an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))
