"""Vectors of numeric features in array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fields import numeric_value


def feature_vector(fields: Column, indexes: list[int]) -> Column:
    """The numbers at these positions; null if any is missing or not a number."""
    values = F.array(*[numeric_value(F.get(fields, F.lit(i))) for i in indexes])
    return F.when(F.forall(values, lambda x: x.isNotNull()), values)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)))
