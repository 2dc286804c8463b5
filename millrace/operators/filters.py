"""Row filters and message classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import strip

# Message classes that are worth a retry, and the pattern that marks each.
RETRYABLE_MESSAGES: dict[str, str] = {
    "no_route": "No route to host",
    "closed": "Connection closed",
    "refused": "Connection refused",
    "timed_out": "timed out*",
    "denied": "Permission denied",
}

# Header and placeholder entries of an image listing.
LISTING_SENTINELS = ("REPOSITORY", "<none>")


def filter_range_count(df: DataFrame, col: str, hi: Any, out: str = "cnt") -> DataFrame:
    """How many non-null values of ``col`` lie below ``hi``."""
    return df.filter(F.col(col) < F.lit(hi)).agg(F.count(col).alias(out))


def lookup_by_secondary_key(df: DataFrame, col: str, value: Any) -> DataFrame:
    """All columns of the rows whose non-key column equals ``value``."""
    return df.filter(F.col(col) == F.lit(value))


def filter_by_property(vertices: DataFrame, key: str, value: Any) -> DataFrame:
    """Vertices whose property ``key`` equals ``value``."""
    return vertices.filter(F.col(key) == F.lit(value))


def filter_by_constraints(df: DataFrame, constraints: Mapping[str, Any]) -> DataFrame:
    """Rows that meet every equality; no constraint keeps every row, ``None`` asks for null."""
    tests = [F.col(path).eqNullSafe(F.lit(value)) for path, value in constraints.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def lines_containing(df: DataFrame, needles: Mapping[str, str], col: str = "line") -> DataFrame:
    """One row with, per output name, the number of lines that contain its needle."""
    return df.agg(
        *[F.count_if(F.contains(F.col(col), F.lit(n))).alias(name) for name, n in needles.items()]
    )


def classify_messages(
    df: DataFrame,
    col: str,
    rules: Mapping[str, str] = RETRYABLE_MESSAGES,
    otherwise: str = "other",
) -> DataFrame:
    """Label each message with the first matching rule; any match makes it retryable.

    Patterns are searched anywhere in the text and ``.`` also matches line ends.
    """
    label: Column = reduce(
        lambda chain, rule: chain.when(F.col(col).rlike("(?s)" + rule[1]), F.lit(rule[0])),
        rules.items(),
        F.when(F.col(col).isNull(), F.lit(otherwise)),
    ).otherwise(F.lit(otherwise))
    return df.withColumn("reason", label).withColumn("retryable", F.col("reason") != otherwise)


def exclude_sentinels(
    df: DataFrame,
    col: str,
    bad: Sequence[str] = LISTING_SENTINELS,
    name_pattern: str | None = None,
) -> DataFrame:
    """Trim ``col`` and drop blanks and placeholder rows; optionally keep a name pattern only."""
    rows = df.withColumn(col, strip(F.col(col)))
    rows = rows.filter((F.col(col) != "") & ~F.col(col).isin(list(bad)))
    return rows.filter(F.col(col).rlike(name_pattern)) if name_pattern else rows


def exists_where(df: DataFrame, key: Mapping[str, Any], status: Mapping[str, Any]) -> DataFrame:
    """One boolean row: is there a row with this key and this status?"""
    hit = filter_by_constraints(df, {**key, **status}).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))
