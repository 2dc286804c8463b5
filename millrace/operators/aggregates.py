"""Counts, text statistics, error measures and per-host reductions.

All of them use aggregates with a map-side partial step, so a key that holds a large
share of the rows is already reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import distance
from millrace.functions.display import display_width
from millrace.functions.strings import strip, words

# Fixed value: cells of the two frame marks around a table.
FRAME_CELLS = 2


def count_by_key(df: DataFrame, key: str, out: str = "cnt") -> DataFrame:
    """Rows per key; rows without a key form a group whose count is zero."""
    return df.groupBy(key).agg(F.count(key).alias(out))


def tokens(df: DataFrame, col: str, out: str = "word") -> DataFrame:
    """One row per white-space separated token."""
    return df.select(F.explode(words(F.col(col))).alias(out))


def word_count(df: DataFrame, col: str) -> DataFrame:
    """Occurrences per token; case and punctuation count."""
    return tokens(df, col).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def word_mean(df: DataFrame, col: str) -> DataFrame:
    """Mean token length."""
    size = F.char_length("word")
    return tokens(df, col).agg((F.sum(size) / F.count(F.lit(1))).alias("mean_length"))


def word_median(df: DataFrame, col: str) -> DataFrame:
    """Median token length; the lower middle one for an even number of tokens."""
    lengths = tokens(df, col).select(F.char_length("word").alias("n"))
    return lengths.agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("bigint").alias("median_length")
    )


def sum_distance(df: DataFrame, point: str, centre: str, out: str = "wssse") -> DataFrame:
    """Sum of the Euclidean distances between points and their centres."""
    return df.agg(F.sum(distance(F.col(point), F.col(centre))).alias(out))


def mean_squared_error(df: DataFrame, actual: str, predicted: str, out: str = "mse") -> DataFrame:
    gap = F.col(actual) - F.col(predicted)
    return reduce_sum_count(df.select((gap * gap).alias("value")), "value").select(
        (F.col("total") / F.col("cnt")).alias(out)
    )


def training_error(df: DataFrame, label: str, predicted: str, out: str = "error") -> DataFrame:
    """Share of rows whose prediction differs from the label."""
    wrong = F.count_if(F.col(label) != F.col(predicted))
    return df.agg((wrong / F.count(F.lit(1))).alias(out))


def reduce_sum_count(df: DataFrame, col: str) -> DataFrame:
    """Sum and row count in one pass."""
    return df.agg(F.sum(col).alias("total"), F.count(F.lit(1)).alias("cnt"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(col).distinct().orderBy(col)


def degree_histogram(degrees: DataFrame, col: str = "degree") -> DataFrame:
    """How many vertices have each degree, most frequent first."""
    return (
        degrees.groupBy(col)
        .agg(F.count(F.lit(1)).alias("vertices"))
        .orderBy(F.desc("vertices"), F.asc(col))
    )


def shape(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(
        F.count(F.lit(1)).alias("rowcount"), F.lit(len(df.columns)).cast("bigint").alias("colcount")
    )


def column_widths(
    df: DataFrame,
    min_width: Mapping[str, int] | None = None,
    max_width: Mapping[str, int] | None = None,
    header: bool = True,
    min_table_width: int | None = None,
    max_table_width: int | None = None,
    padding: int = 1,
) -> DataFrame:
    """One row: the display width of each column of text, header included.

    ``max_width`` caps what a cell may ask for, ``min_width`` sets a floor once there is a
    row.  A table outside the given total widths (cells, padding, two frame marks) has its
    columns scaled in proportion, down with a floor or up with a ceiling.
    """
    low, high = min_width or {}, max_width or {}

    def width(name: str) -> Column:
        cell = display_width(F.coalesce(F.col(name).cast("string"), F.lit("None")))
        if name in high:
            cell = F.least(cell, F.lit(high[name]))
        if name in low:
            cell = F.greatest(cell, F.lit(low[name]))
        head = display_width(F.lit(name)) if header else F.lit(0)
        return F.greatest(F.max(cell), head).cast("int").alias(name)

    widths = df.agg(*[width(c) for c in df.columns])
    if max_table_width:
        widths = _scaled(widths, max_table_width, padding, shrink=True)
    if min_table_width:
        widths = _scaled(widths, min_table_width, padding, shrink=False)
    return widths


def _scaled(widths: DataFrame, limit: int, padding: int, shrink: bool) -> DataFrame:
    names = widths.columns
    total = F.lit(FRAME_CELLS + 2 * padding * len(names))
    for name in names:
        total = total + F.col(name)
    scale = F.lit(float(limit)) / total
    outside = total > limit if shrink else total < limit
    rounded = F.floor if shrink else F.ceil
    return widths.select(
        *[
            F.when(outside, rounded(F.col(n) * scale)).otherwise(F.col(n)).cast("int").alias(n)
            for n in names
        ]
    )


def outputs_by_host(df: DataFrame, host: str, output: str, seq: str) -> DataFrame:
    """Trimmed non-blank output per host; the latest entry wins."""
    said = df.withColumn(output, strip(F.col(output))).filter(F.col(output) != "")
    return said.groupBy(host).agg(F.max_by(output, seq).alias(output))

