"""Literal and generated rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters in the key and in a whole generated record.
KEY_CHARS = 10
RECORD_CHARS = 100


def rows_literal(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """Rows written out in the job itself; the planner knows their size and can broadcast them."""
    names = spark.createDataFrame([], schema).columns
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema)


def generate_records(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` records to sort: a ten-character random key and a payload, 100 characters in all.

    The key is a hash of the row number, so any part of the data can be made again alone.
    """
    text = F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"))
    key = F.upper(F.substring(F.md5(text), 1, KEY_CHARS))
    payload = F.lpad(F.col("id").cast("string"), RECORD_CHARS - KEY_CHARS, "0")
    return spark.range(n).select(key.alias("key"), payload.alias("payload"))
