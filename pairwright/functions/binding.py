"""Bind an intermediate value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column expression used inside an array lambda is computed again for every element; as a lambda
    variable it is computed once, which keeps work on long arrays linear.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
