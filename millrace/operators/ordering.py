"""Sorting, slices and first-match picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.numbering import as_columns, number_copies, number_rows, rows_between


def row_order(df: DataFrame, by: str, reverse: bool = False) -> list[Column]:
    """Sort key: the field, then the whole row from left to right; ``reverse`` flips all."""
    names = [by, *df.columns]
    return [F.desc(c) if reverse else F.asc(c) for c in names]


def sort_rows(df: DataFrame, by: str, reverse: bool = False, unique: bool = False) -> DataFrame:
    """Total order by a field, ties broken by the whole row.

    Equal rows get copy numbers first, so a row that fills much of the table can still be
    cut into several range partitions; ``unique=True`` promises that no rows are equal.
    """
    return _ordered(df, row_order(df, by, reverse), unique)


def sort_by_expression(
    df: DataFrame, key: Column, reverse: bool = False, unique: bool = False
) -> DataFrame:
    """Total order by a user expression, ties broken by the whole row (see ``sort_rows``)."""
    keys = [key, *[F.col(c) for c in df.columns]]
    return _ordered(df, [k.desc() if reverse else k.asc() for k in keys], unique)


def _ordered(df: DataFrame, keys: list[Column], unique: bool) -> DataFrame:
    if unique:
        return df.orderBy(*keys)
    return number_copies(df, "__copy").orderBy(*keys, "__copy").drop("__copy")


def slice_rows(
    df: DataFrame, by: str, start: int = 0, end: int | None = None, reverse: bool = False
) -> DataFrame:
    """Rows ``[start, end)`` of the sorted table."""
    return rows_between(df, row_order(df, by, reverse), start, end)


def slice_then_sort(
    df: DataFrame,
    input_order: Sequence[str],
    by: str,
    start: int = 0,
    end: int | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Rows ``[start, end)`` in input order, sorted afterwards."""
    return sort_rows(rows_between(df, input_order, start, end), by, reverse)


def index_row(df: DataFrame, order: Sequence[str], index: int) -> DataFrame:
    """The one row at a 0-based position as a table of its own."""
    return rows_between(df, order, index, index + 1)


def total_order_sort(df: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Globally sorted output in range partitions, ties broken by the whole row.

    Equal rows get copy numbers first, so they too can be cut into several partitions;
    ``unique=True`` promises that there are none.
    """
    keys = [key, *[c for c in df.columns if c != key]]
    if unique:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    keys = [*keys, "__copy"]
    rows = number_copies(df, "__copy")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__copy")


def first_n_joined(
    df: DataFrame, group: Sequence[str], value: str, order: Sequence[str], n: int = 6, sep: str = ","
) -> DataFrame:
    """The first ``n`` values of each group as one text.

    Only the first ``n`` rows of a group leave each task, so large groups stay cheap.
    """
    place = Window.partitionBy(*group).orderBy(*as_columns(order))
    heads = df.withColumn("__pos", F.row_number().over(place)).filter(F.col("__pos") <= n)
    listed = F.array_sort(F.collect_list(F.struct("__pos", F.col(value).alias("v"))))
    return heads.groupBy(*group).agg(
        F.array_join(F.transform(listed, lambda s: s["v"].cast("string")), sep).alias(value)
    )


def first_match_per_group(
    df: DataFrame, group: Sequence[str], value: str, position: str, match: Column
) -> DataFrame:
    """Per group, the value of the first row that matches."""
    hits = df.filter(match)
    return hits.groupBy(*group).agg(F.min_by(value, position).alias(value))


def sorted_positions(
    df: DataFrame, by: str, reverse: bool = False, out: str = "rn", unique: bool = False
) -> DataFrame:
    """The table with each row's 1-based place in its sorted order."""
    return number_rows(df, row_order(df, by, reverse), out, unique)
