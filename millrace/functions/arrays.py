"""Vector and list expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def sum_of_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(sum_of_squares(a))


def distance(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))


def first_joined(a: Column, n: int = 6, sep: str = ",") -> Column:
    """At most the first ``n`` items as one text."""
    return F.array_join(F.slice(a, 1, n), sep)
