"""Vector expressions over ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    """Euclidean length, summed in element order."""
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the length of the shorter vector."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a missing, empty or zero vector."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))
