"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ColumnLike, col


def doubles(c: ColumnLike) -> Column:
    return col(c).cast("array<double>")


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: ColumnLike, floor: float = 1e-8) -> Column:
    """L2 norm, not below ``floor``."""
    return F.greatest(F.sqrt(dot(c, c)), F.lit(float(floor)))


def unit(c: ColumnLike, floor: float = 1e-8) -> Column:
    size = norm(c, floor)
    return F.transform(doubles(c), lambda x: x / size)


def cosine(a: ColumnLike, b: ColumnLike, floor: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a, floor) * norm(b, floor))


def mean_abs_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """Mean absolute difference of two equally long arrays."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.size(col(a)))


def entropy(c: ColumnLike) -> Column:
    """-sum p ln p of an array of probabilities; zeros count nothing."""
    return F.aggregate(doubles(c), F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
