"""Text, delimited, vector and document files; every reader takes or has a fixed schema."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS_SCHEMA = "userid int, movieid int, rating int, unixtime string"


def scan_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Typed delimited text without header; a field that does not fit its type is null."""
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("quote", "")
        .csv(path)
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of text."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def doubles(line: Column, sep: str = " ") -> Column:
    """An array of doubles from separated text."""
    return F.split(line, sep).cast("array<double>")


def scan_vectors(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """One array of doubles per line."""
    return spark.read.text(path).select(doubles(F.col("value"), sep).alias("point"))


def as_vectors(df: DataFrame, col: str = "point", out: str = "features") -> DataFrame:
    """Arrays as MLlib vectors."""
    return df.withColumn(out, array_to_vector(F.col(col)))


def scan_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user,item,rating`` lines; ids may be written as floats."""
    rows = spark.read.schema("user double, item double, rating double").csv(path)
    return rows.withColumns({"user": F.col("user").cast("bigint"), "item": F.col("item").cast("bigint")})


def scan_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """``label,f1 f2 ...`` lines: commas count as spaces, the first number is the label."""
    numbers = doubles(F.translate("value", ",", " "))
    rows = spark.read.text(path).select(numbers.alias("__all"))
    return rows.select(
        F.get("__all", F.lit(0)).alias("label"),
        F.slice("__all", F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0))).alias("features"),
    )


def scan_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per line, with a declared schema; unknown fields are ignored."""
    return spark.read.schema(schema).json(path)
