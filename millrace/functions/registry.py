"""User functions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def register_sql_function(spark: SparkSession, name: str, signature: str, body: str) -> None:
    """Register a function whose body is a SQL expression; it stays inside the JVM plan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURN {body}")


def register_function(spark: SparkSession, name: str, fn: Callable) -> None:
    """Register a vectorised (pandas) function for use in SQL."""
    spark.udf.register(name, fn)


def list_functions(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Name, class and temporary flag of the known functions."""
    rows = [(f.name, f.className, f.isTemporary) for f in spark.catalog.listFunctions(pattern=pattern)]
    return spark.createDataFrame(rows, "name string, class_name string, is_temporary boolean")
