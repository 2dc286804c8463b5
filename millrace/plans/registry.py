"""Query registry: each plan is bound to a key and, where SQL can say it, to reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of one directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self._dir, name)


def plan(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``sql`` is the DuckDB equivalent."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap
