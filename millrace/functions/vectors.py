"""Column functions on arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.reduce(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Of length one; the zero vector stays."""
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)
