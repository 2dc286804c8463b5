"""Tables, views and result directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted_name(dotted: str) -> str:
    """A table or database name in SQL text; its parts may hold any characters but dots."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in dotted.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database if it is missing, and make it the current one."""
    where = " LOCATION " + _text(location) if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted_name(name)}{where}")
    spark.sql(f"USE {quoted_name(name)}")


def convert_to_columnar(df: DataFrame, table: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A columnar copy of a table; returns the copy."""
    writer = df.write.format(fmt).mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def insert_append(df: DataFrame, table: str) -> None:
    """Append rows; running it again appends them again."""
    df.write.mode("append").insertInto(table)


def load_overwrite(df: DataFrame, table: str) -> None:
    """Replace the contents of a table."""
    df.write.mode("overwrite").insertInto(table)


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted_name(table)}")


def write_partitioned(
    df: DataFrame, table: str, keys: Sequence[str], path: str | None = None
) -> None:
    """A table with one directory per key tuple.

    Rows are brought together by key, so the number of files does not multiply with the
    tasks; adaptive execution splits the rows of a large key over several writers.
    """
    writer = _rebalanced(df, keys).write.partitionBy(*keys).mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def _rebalanced(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    head = [parts] if parts else []
    return df.hint("rebalance", *head, *[F.col(k) for k in keys])


def list_partitions(spark: SparkSession, table: str) -> DataFrame:
    """The key tuples of a partitioned table."""
    return spark.sql(f"SHOW PARTITIONS {quoted_name(table)}")


def bucket_count(df: DataFrame, bucket_bytes: int = 128 << 20) -> int:
    """Buckets of about ``bucket_bytes`` for the files behind a frame, at least one per shuffle task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))


def write_bucketed(
    df: DataFrame,
    table: str,
    buckets: int,
    bucket_cols: Sequence[str],
    sort_cols: Sequence[str] = (),
    path: str | None = None,
) -> None:
    """A table hashed into buckets and sorted inside them; a ``-`` before a sort column turns its order.

    Joins and aggregates on the bucket columns then need no shuffle.  If all order is ascending, a bucket
    that holds far more than its share is split into several files.  With descending columns, which
    Spark's own bucket sort lacks, each bucket is one task's and one file, sorted (with spills) before it is written.
    """
    if any(c.startswith("-") for c in sort_cols):
        _write_in_order(df, table, buckets, bucket_cols, sort_cols, path)
        return
    writer = (
        _rebalanced(df, bucket_cols, buckets)
        .write.bucketBy(buckets, *bucket_cols)
        .mode("errorifexists")
    )
    if sort_cols:
        writer = writer.sortBy(*sort_cols)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def _write_in_order(df, table, buckets, bucket_cols, sort_cols, path) -> None:
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in sort_cols]
    # Dealt by the same hash as the buckets, so that each task holds one of them.
    rows = df.repartition(buckets, *bucket_cols).sortWithinPartitions(*order)
    writer = rows.write.bucketBy(buckets, *bucket_cols).mode("errorifexists")
    if path:
        writer = writer.option("path", path)
    # A writer that may keep files open does not sort rows by bucket first, which could mix up their order.
    setting, conf = "spark.sql.maxConcurrentOutputFileWriters", df.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, "2")
    try:
        writer.saveAsTable(table)
    finally:
        conf.set(setting, before)


def write_job_output(df: DataFrame, path: str) -> None:
    """Tab-separated text without quoting, null as nothing; an existing directory is an error."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *cells)).write.mode("errorifexists").text(path)


def create_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A named query over tables."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quoted_name(name)} AS {query}")
    return spark.table(quoted_name(name))
