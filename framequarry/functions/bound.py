"""A value that an expression uses several times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` held in a lambda variable, so that the optimiser cannot copy its expression into
    every place, nor into a lambda that runs for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)
