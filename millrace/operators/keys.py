"""Distinct keys for joins in which the other side may have hot keys.

Adaptive execution splits the rows of a hot join key only if both sides reach the join
straight from their own shuffle.  A side that was just grouped by the join key does not:
it keeps the partitioning of the grouping.  Grouping by the key and a function of the key
gives the same groups in another partitioning, so the join shuffles them itself; that
extra shuffle moves one small row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = 1024


def spread(keys: Sequence[str]) -> Column:
    """A number that depends on the keys only, to group by in addition to them."""
    return F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).alias("__spread")


def key_set(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``df``, ready to be joined with a side that has hot keys."""
    return df.select(*keys, spread(keys)).distinct().select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, spread_by: Sequence[str], salt: int
) -> DataFrame:
    """Join with the rows of each left key spread over ``salt`` tasks; each meets a copy of ``right``.

    For left sides whose hot keys hold many rows but few bytes, which adaptive execution
    (it goes by bytes) leaves together.  ``how`` must keep each left row by itself: inner,
    left, left_semi or left_anti.  ``salt=1`` is the plain join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    if salt == 1:
        return left.join(right, list(keys), how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salt)))
    numbers = F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")
    copies = right.withColumn("__salt", F.explode(numbers))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def deal_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``rows`` rows each, however few files hold it.

    Rows go by their place, so equal ones are dealt evenly too.  What a task then holds to sort or to
    group its rows does not grow with the table.
    """
    count = df.count()
    if count <= rows:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, count // rows)
    return df.withColumn("__dealt", F.monotonically_increasing_id()).repartition(tasks, "__dealt").drop("__dealt")
