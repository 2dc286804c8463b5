"""Keyed unions and set operations on names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from millrace.operators.keys import key_set


def union_right_precedence(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of two keyed tables; the right row stands where both hold a key."""
    only_left = left.join(key_set(right, key), list(key), "left_anti")
    return only_left.select(*left.columns).unionByName(right)


def union_left_precedence(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of two keyed tables; the left row stands where both hold a key."""
    return union_right_precedence(right, left, key)


def intersect_names(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct names on both lists; each list is reduced before the join."""
    return a.select(col).distinct().intersect(b.select(col).distinct())


def except_names(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct names of the first list that the second one lacks."""
    return a.select(col).distinct().subtract(b.select(col).distinct())


def append_rows_checked(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows by position; a different number of columns is an error."""
    if len(rows.columns) != len(df.columns):
        raise ValueError(f"cannot append rows of {len(rows.columns)} columns to a table of {len(df.columns)}")
    return df.union(rows)


def auto_field_names(df: DataFrame) -> DataFrame:
    """Name the columns ``Field 1``, ``Field 2`` and so on."""
    return df.toDF(*[f"Field {i + 1}" for i in range(len(df.columns))])
