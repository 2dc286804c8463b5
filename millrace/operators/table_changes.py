"""Changes to partitioned tables that rewrite the partitions they touch and leave the others' files alone.

The keys of the changes are looked for in the key columns of the table, which says what partitions hold
them; together with those that receive rows they are the ones to change.  Their next version is written to
the scratch folder first, then put in place, so a job that fails before leaves the table as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import mutations
from millrace.operators.keys import key_set
from millrace.scratch import delete_folder, persist_table
from millrace.sources.sinks import quoted_name


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    found = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    if not found:
        raise ValueError(f"{table} is not partitioned")
    return found


def _within(rows: DataFrame, places: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows of some partitions; a null value is a partition of its own."""
    named = places.toDF(*[f"__{c}" for c in parts])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parts]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return rows.join(named, condition, "left_semi")


def rewrite_partitions(
    spark: SparkSession, table: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> int:
    """Replace the rows of the ``touched`` partitions by ``change`` of them; returns how many partitions.

    ``change`` may only give rows of touched partitions.  A partition that is left without rows goes.
    """
    parts = partition_columns(spark, table)
    touched = persist_table(touched.select(*parts).distinct(), "touched")
    count = touched.count()
    if not count:
        return 0
    base = spark.table(table)
    new = persist_table(change(_within(base, touched, parts)).select(*base.columns), "partitions")
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")  # an insert into a table takes this from the session only
    try:
        new.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(setting, before)
    filled = new.select(*parts).distinct()
    named = filled.toDF(*[f"__{c}" for c in parts])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parts]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    # Partitions, not rows: their number is what the catalog holds anyway.
    for gone in touched.join(named, condition, "left_anti").collect():
        spec = ", ".join(f"{quoted_name(c)} = {_literal(gone[c])}" for c in parts)
        about = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted_name(table)} PARTITION ({spec})")
        place = about.filter("col_name = 'Location'").first()
        spark.sql(f"ALTER TABLE {quoted_name(table)} DROP IF EXISTS PARTITION ({spec})")
        if place:  # a table with a folder of its own choice keeps the files of a dropped partition
            delete_folder(spark, place["data_type"])
    return count


def _literal(value) -> str:
    if value is None:
        return "NULL"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _holding(base: DataFrame, keys: DataFrame, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    columns = list(dict.fromkeys([*parts, *key]))
    return base.select(*columns).join(keys, list(key), "left_semi").select(*parts)


def upsert_table(spark: SparkSession, table: str, changes: DataFrame, key: Sequence[str], seq: Sequence[str]) -> int:
    """``mutations.upsert_by_key`` in place; a row whose partition changes leaves its old one."""
    parts, base = partition_columns(spark, table), spark.table(table)
    newest = persist_table(mutations.newest_by_key(changes, key, seq).select(*base.columns), "newest")
    touched = _holding(base, key_set(newest, key), key, parts).unionByName(newest.select(*parts))

    def change(old: DataFrame) -> DataFrame:
        return old.join(key_set(newest, key), list(key), "left_anti").select(*base.columns).unionByName(newest)

    return rewrite_partitions(spark, table, touched, change)


def replace_in_table(spark: SparkSession, table: str, new: DataFrame, key: Sequence[str]) -> int:
    """``mutations.replace_rows`` in place."""
    parts, base = partition_columns(spark, table), spark.table(table)
    rows = persist_table(new.select(*base.columns), "replacing")
    touched = _holding(base, key_set(rows, key), key, parts).unionByName(rows.select(*parts))
    return rewrite_partitions(spark, table, touched, lambda old: mutations.replace_rows(old, rows, key))


def delete_from_table(spark: SparkSession, table: str, predicate: Column) -> int:
    """``mutations.delete_where`` in place."""
    parts = partition_columns(spark, table)
    touched = spark.table(table).filter(predicate).select(*parts)
    return rewrite_partitions(spark, table, touched, lambda old: mutations.delete_where(old, predicate))


def set_fields_in_table(
    spark: SparkSession, table: str, changes: DataFrame, key: str, fields: Sequence[str], seq: str
) -> int:
    """``mutations.set_fields`` in place, for known keys; fields that decide the partition cannot be set so."""
    parts, base = partition_columns(spark, table), spark.table(table)
    if set(parts) & set(fields):
        raise ValueError("a field that decides the partition needs an upsert")
    touched = _holding(base, key_set(changes, [key]), [key], parts)
    return rewrite_partitions(
        spark, table, touched, lambda old: mutations.set_fields(old, changes, key, fields, seq, upsert=False)
    )
