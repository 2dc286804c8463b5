"""Directory trees of small files: application manifests, directive files, logs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.strings import file_extension, file_stem, words
from millrace.operators.projections import PREVIEW_CHARS, truncate_description
from millrace.sources import trees

# Extensions of manifests and the defaults of their optional fields.
YAML_EXTENSIONS = ("yaml", "yml")
EXTENSIONS = ("json", *YAML_EXTENSIONS)
UNKNOWN = "Unknown"

MANIFEST_SCHEMA = (
    "metadata struct<author:string,version:string,description:string,icon:string,"
    "tags:array<string>,url:string>,"
    "params map<string,string>,"
    "questions array<struct<question:string,param:string>>,"
    "backend array<struct<"
    "storage:struct<personality:string,instances:string,layers:array<string>>,"
    "compute:array<struct<personality:string,instances:string,layers:array<string>>>>>,"
    "connectors array<struct<personality:string,name:string,instances:string,ports:array<string>>>"
)


def _yaml_to_json():
    """A vectorised column function; built here so that workers need not import this package."""

    def convert(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        return texts.map(
            lambda t: json.dumps(yaml.load(t, Loader=loader), default=str), na_action="ignore"
        )

    return F.pandas_udf(convert, T.StringType())


def read_small_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """``path, content`` of every file below ``root``."""
    read = trees.read_files(trees.list_files(spark, root, extensions), root)
    return read.select(_below(root).alias("path"), "content")


def _below(root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), "name")


def scan_manifests(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Manifests in a directory tree, by extension, optionally one name only."""
    listing = trees.list_files(spark, root, EXTENSIONS)
    if name is not None:  # other files are not opened
        listing = listing.filter(file_stem(F.col("name")) == name)
    read = trees.read_files(listing, root)
    return parse_manifests(read.select(_below(root).alias("path"), "content"), name)


def parse_manifests(files: DataFrame, name: str | None = None) -> DataFrame:
    """Manifest fields with their defaults from ``path, content``.

    A file without metadata keeps its name and takes the defaults for all else.
    """
    named = files.select(
        file_stem(F.col("path")).alias("name"),
        F.lower(file_extension(F.col("path"))).alias("__ext"),
        "path",
        "content",
    )
    if name is not None:
        named = named.filter(F.col("name") == name)
    in_yaml = F.col("__ext").isin(*YAML_EXTENSIONS)
    converted = _yaml_to_json()(F.when(in_yaml, F.col("content")))
    docs = named.filter((F.col("__ext") == "json") | in_yaml).withColumn(
        "content", F.when(in_yaml, converted).otherwise(F.col("content"))
    )
    docs = docs.withColumn("doc", F.from_json("content", MANIFEST_SCHEMA))
    meta = F.col("doc.metadata")
    known = meta.isNotNull()

    def text(field: str, default: str) -> Column:
        return F.when(known, meta[field]).otherwise(F.lit(default)).alias(field)

    no_tags = F.array().cast("array<string>")
    no_questions = F.from_json(F.lit("[]"), "array<struct<question:string,param:string>>")
    rows = docs.select(
        "name",
        F.when(known, F.col("path")).otherwise(F.lit("")).alias("file"),
        F.when(known, meta["tags"]).otherwise(no_tags).alias("tags"),
        text("author", UNKNOWN),
        text("version", UNKNOWN),
        text("url", ""),
        text("description", ""),
        F.coalesce(meta["icon"], F.lit("")).alias("icon"),
        F.coalesce("doc.questions", no_questions).alias("questions"),
        F.struct("doc.params", "doc.backend", "doc.connectors").alias("plan"),
        known.alias("__known"),
    )
    short = truncate_description(rows, "description", PREVIEW_CHARS)
    return short.withColumn("short", F.when(F.col("__known"), F.col("short")).otherwise("")).drop(
        "__known"
    )


def scan_directives(spark: SparkSession, root: str, keywords: Sequence[str]) -> DataFrame:
    """Keyword lines of the files below ``root``."""
    return parse_directives(read_small_files(spark, root), keywords)


def parse_directives(files: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``path, line_no, keyword, argument`` from ``path, content``.

    Keywords are matched without regard to case, words are separated by white space,
    blank lines are skipped.
    """
    wanted = [k.upper() for k in keywords]
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    split = lines.select("path", "line_no", words(F.col("line")).alias("__words"))
    return split.select(
        "path",
        "line_no",
        F.upper(F.get("__words", F.lit(0))).alias("keyword"),
        F.get("__words", F.lit(1)).alias("argument"),
    ).filter(F.col("keyword").isin(wanted))


def directive_bases(directives: DataFrame) -> DataFrame:
    """``child, base``: every NAME of a file with the last path segment of its first FROM."""
    first = (
        directives.filter(F.col("keyword") == "FROM")
        .groupBy("path")
        .agg(F.min_by("argument", "line_no").alias("__from"))
        .select("path", F.substring_index("__from", "/", -1).alias("base"))
    )
    names = directives.filter(F.col("keyword") == "NAME")
    return names.join(first, "path").select(F.col("argument").alias("child"), "base")


def relative_names(spark: SparkSession, root: str) -> DataFrame:
    """Distinct ``dir/name`` of every file below ``root``; contents are not read."""
    return trees.list_files(spark, root).select("name").distinct()


def collect_logs(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the log trees ``<stack>/{storage,compute}/...`` below ``root``."""
    lines = trees.read_lines(trees.list_files(spark, root), root)
    return parse_logs(lines.select(_below(root).alias("path"), "line"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """``stack, class, path, line`` from ``path, line``; other files are left out."""
    place = r"([^/]+)/(storage|compute)/(.+)$"
    return lines.select(
        F.regexp_extract("path", place, 1).alias("stack"),
        F.regexp_extract("path", place, 2).alias("class"),
        F.regexp_extract("path", place, 3).alias("path"),
        "line",
    ).filter(F.col("stack") != "")
