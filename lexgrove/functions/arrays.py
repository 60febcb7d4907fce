"""Set algebra and arithmetic on array Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_union(a: Column, b: Column) -> Column:
    """Distinct items of both, ascending."""
    return F.array_sort(F.array_union(a, b))


def sorted_intersect(a: Column, b: Column) -> Column:
    """Distinct items that are in both, ascending."""
    return F.array_sort(F.array_intersect(a, b))


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)
