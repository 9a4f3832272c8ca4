"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed.

    Written twice, an expression may be evaluated twice; written inside a lambda over an array, once
    per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
