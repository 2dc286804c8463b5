"""Global row numbers and positional access without a single-task window.

Rows are range-partitioned on the requested order and written once; the row counts of
the written partitions (one number per partition) turn positions inside a partition
into global positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.scratch import persist_table

# Elements produced by one explode step; longer runs go through a second step on other tasks.
RUN_CHUNK = 100_000

# Up to this many leading rows, tasks keep their own best rows and groups of tasks merge them
# (the planner's own bound for a partial row limit); positions beyond it need the numbered sort.
TOP_K_ROWS = 1000
MERGE_GROUPS = 256

_PART_BITS = 33  # monotonically_increasing_id keeps the partition in the bits above these


def as_columns(order: Sequence[Column | str] | Column | str) -> list[Column]:
    names = [order] if isinstance(order, (str, Column)) else order
    return [F.col(c) if isinstance(c, str) else c for c in names]


def explode_range(df: DataFrame, count: Column, out: str) -> DataFrame:
    """One copy of each row per value of ``0 .. count-1``, built in chunks of bounded size."""
    chunk, total = "__chunk", "__total"
    rows = df.withColumn(total, count.cast("bigint")).filter(F.col(total) > 0)
    rows = rows.withColumn(
        chunk, F.explode(F.sequence(F.lit(0), F.expr(f"({total} - 1) div {RUN_CHUNK}")))
    )
    low = F.col(chunk) * RUN_CHUNK
    high = F.least(F.col(total), low + RUN_CHUNK) - 1
    return rows.withColumn(out, F.explode(F.sequence(low, high))).drop(chunk, total)


def _has_fraction(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_fraction(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_fraction(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def number_copies(df: DataFrame, out: str) -> DataFrame:
    """Give equal rows distinct numbers ``0, 1, ...``, so that no two rows are the same.

    Equal rows are counted with a map-side partial step.  Runs of copies are cut into
    chunks and the chunks spread over the cluster before they become rows again, so a
    value that holds a large share of the table is never written out by one task.
    """
    # Grouping turns -0.0 into 0.0, so columns with fractions are told apart by their text
    # and come back as they were.
    loose = [f.name for f in df.schema.fields if _has_fraction(f.dataType)]
    marks = {f"__text_{i}": F.to_json(F.struct(F.col(c))) for i, c in enumerate(loose)}
    exact = [c for c in df.columns if c not in loose]
    counted = (
        df.withColumns(marks)
        .groupBy(*exact, *marks)
        .agg(F.count(F.lit(1)).alias("__copies"), *[F.any_value(c).alias(c) for c in loose])
    )
    once = counted.filter("__copies = 1").select(*df.columns, F.lit(0).cast("bigint").alias(out))
    runs = counted.filter("__copies > 1").withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(__copies - 1) div {RUN_CHUNK}")))
    )
    # A fixed number of partitions, as adaptive execution would merge these few short rows
    # into one task again before they grow.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(parts, *df.columns, "__chunk")
    low = F.col("__chunk") * RUN_CHUNK
    high = F.least(F.col("__copies"), low + RUN_CHUNK) - 1
    return once.unionByName(runs.select(*df.columns, F.explode(F.sequence(low, high)).alias(out)))


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str] | Column | str,
    out: str = "rn",
    unique: bool = False,
) -> DataFrame:
    """Add the 1-based global position of each row under ``order``.

    Ties are broken by the whole row and, among equal rows, by a copy number, so the sort
    can cut even one value that fills much of the table into several range partitions.
    ``unique=True`` promises that ``order`` has no ties and saves that step.
    """
    keys = as_columns(order)
    rows = df
    if not unique:
        rows = number_copies(df, "__copy")
        keys = [*keys, *df.columns, "__copy"]
    return positions(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*df.columns), out)


def positions(ordered: DataFrame, out: str = "rn") -> DataFrame:
    """Add the 1-based place of each row in a frame whose partitions follow its order."""
    placed = ordered.select("*", F.monotonically_increasing_id().alias("__id")).withColumn(
        "__part", F.shiftright("__id", _PART_BITS)
    )
    placed = persist_table(placed, "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # One row per written partition, so a single-task window and a broadcast are bounded.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    inside = F.col("__id") - F.shiftleft("__part", _PART_BITS)
    return placed.join(F.broadcast(offsets), "__part").select(
        *ordered.columns, (F.col("__offset") + inside + 1).alias(out)
    )


def top_rows(df: DataFrame, order: Sequence[Column | str] | Column | str, n: int) -> DataFrame:
    """The first ``n`` rows under ``order`` (in any order), found in a tree of partial results.

    Every task keeps ``n`` rows, groups of tasks are merged next, and only the best rows
    of each group are left for the caller's final sort.
    """
    group = Window.partitionBy("__group").orderBy(*as_columns(order))
    return (
        df.withColumn("__group", F.spark_partition_id() % MERGE_GROUPS)
        .withColumn("__pos", F.row_number().over(group))
        .filter(F.col("__pos") <= n)
        .drop("__group", "__pos")
    )


def rows_between(
    df: DataFrame, order: Sequence[Column | str] | Column | str, start: int, end: int | None
) -> DataFrame:
    """Rows at 0-based positions ``[start, end)`` under ``order``, ties broken by the whole row.

    Without an ``end`` the slice goes on to the last row.
    """
    if start < 0 or (end is not None and end < start):
        raise ValueError(f"invalid row range [{start}, {end})")
    if end is None and start == 0:
        return df
    if end is not None and end <= TOP_K_ROWS:
        keys = [*as_columns(order), *df.columns]
        return top_rows(df, keys, end).orderBy(*keys).offset(start).limit(end - start)
    numbered = number_rows(df, order, "__rn").filter(F.col("__rn") > start)
    if end is not None:
        numbered = numbered.filter(F.col("__rn") <= end)
    return numbered.drop("__rn")
