"""Vectors as array<double> columns; the dimension is a parameter, never fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(values: Sequence[float]) -> list[float]:
    """A query vector at length 1; a zero vector stays."""
    length = sum(float(v) ** 2 for v in values) ** 0.5
    return [float(v) / length if length > 0 else float(v) for v in values]


def valid(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim)


def mean_abs_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.lit(1), F.size(a))
