"""Bounded samples of labelled documents for fitting, and the split that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows with this remainder of crc32(id as text) are never learnt from.
FOLDS, HELD_OUT = 4, 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents that may be learnt from, at most ``rows_per_class`` of each class, with ``__label``.

    Ids are drawn by hash, so the sample does not depend on the layout of the tables.
    An id with labels of both classes counts as 0.  Of rows that share an id one is taken, that with the
    smallest hash of ``text``, so the sample is bounded by the parameter, and so is what the broadcast sends.
    """
    open_ = labels.filter(~is_held_out(F.col(doc_id)) & F.col(doc_id).isNotNull())
    picked = [
        open_.filter(F.col(label) == value)
        .select(F.col(doc_id).alias("__id"), F.lit(value).alias("__label"))
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows_per_class)
        for value in (0, 1)
    ]
    sample = picked[0].unionByName(picked[1]).groupBy("__id").agg(F.min("__label").alias("__label"))
    rows = docs.join(F.broadcast(sample), F.col(doc_id) == F.col("__id"))
    # Only the first row of an id leaves each task, so an id with very many rows does not gather in one place.
    first = Window.partitionBy("__id").orderBy(F.xxhash64(text), text)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__id", "__n")
