"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions.binding import bind

TINY_SQUARED_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Column, floor: float = 1e-6) -> Column:
    """Scale to length one; a vector shorter than ``floor`` is divided by the floor."""
    norm = F.greatest(F.sqrt(squared_norm(a)), F.lit(floor))
    return bind(norm, lambda n: F.transform(a, lambda x: x / n))


def plain_cosine(a: Column, b: Column) -> Column:
    """For vectors already stored at unit length: the dot product, 0 when lengths differ."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, dot(a, b)).otherwise(0.0)


def guarded_cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or near-zero vectors, so a track without crops matches nothing."""
    norms = F.struct(squared_norm(a).alias("a"), squared_norm(b).alias("b"))
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    usable = lambda n: same & (n["a"] >= TINY_SQUARED_NORM) & (n["b"] >= TINY_SQUARED_NORM)
    return bind(norms, lambda n: F.when(usable(n), dot(a, b) / (F.sqrt(n["a"]) * F.sqrt(n["b"]))).otherwise(0.0))
