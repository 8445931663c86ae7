"""Column functions over array<float> vectors, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda m, x: m + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda m, x: m + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y))
