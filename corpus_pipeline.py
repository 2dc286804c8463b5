"""From raw documents to a training mix, one operator per stage.

quality -> near duplicates -> repeated passages -> benchmark leaks -> mix.  Each stage takes the
documents that the one before kept and returns documents with the same columns; the last adds
``copy``, the number of a repeated document.  Every stage is written as Parquet before the next
reads it, so lost executors cost one stage at most.

Cases: null texts pass as empty ones wherever a stage looks at texts; equal rows are near
duplicates and repeat each other; an empty table gives an empty mix; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, mixing, quality_net, suffix_dedup
from millrace.scratch import owned_by, release_owned, scratch_path
from millrace.tables import load

THRESHOLD = 0.7
OWNER = "pipeline"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(function: Stage) -> Stage:
    """A stage frees the scratch tables of the stage before, whose result is written by now."""

    @wraps(function)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_owned(spark, OWNER)
        with owned_by(OWNER):
            return function(spark, docs, sf_dir)

    return started


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier scores at ``THRESHOLD`` or more."""
    model = quality_net.fit_model(docs, load(spark, sf_dir, "labels"))
    return quality_net.score(docs, model, out="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return jaccard.one_of_each(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the passages of 200 bytes and more that occur twice; ``n_chars`` follows the text."""
    rows = suffix_dedup.remove_repeats(docs.withColumnsRenamed({c: f"__own_{c}" for c in _CLASHING if c in docs.columns}))
    changed = F.col("n_removed") > 0
    values = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    rows = rows.withColumns(values).drop(*_CLASHING)
    return rows.withColumnsRenamed({f"__own_{c}": c for c in _CLASHING}).select(*docs.columns)


_CLASHING = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.emit_mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
]

#: The network, the regions and the suffixes are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = scratch_path(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    release_owned(spark, OWNER)
    return docs
