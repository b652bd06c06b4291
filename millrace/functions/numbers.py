"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """A double, or null for what isn't a finite number."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def int_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def hash_uniform(*columns: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) that the columns fix: 32 bits of the md5 of their texts, joined by bars."""
    bits = F.conv(F.left(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), F.lit(8)), 16, 10).cast("long")
    return low + (high - low) * (bits / float(2**32))


def softmax_label(positive: Column, negative: Column) -> tuple[Column, Column]:
    """(label, probability of it) of two logits; equal ones are positive."""
    top = F.greatest(positive, negative)
    p, n = F.exp(positive - top), F.exp(negative - top)
    return F.when(p >= n, "positive").otherwise("negative"), F.greatest(p, n) / (p + n)
