"""Mix sources to target weights by systematic sampling, in DataFrame operations only.

The size of a document is its number of words.  Sources in code-point order (null last)
get the weights 5, 2, 1 in turn and share the words of all documents by weight; no
target exceeds ``cap`` times its source, and the excess goes to the others by weight.

Within a source the documents stand by size, largest first.  Each expects
``target / source size`` copies; the running sum of the expected copies starts at one
random offset per source, and a document is emitted once for each integer that the sum
passes.  As sizes fall along the order, a source's words miss the target by less than
its longest document.  The offset is a hash of the source, so reruns agree.

Cases: null texts and texts without words have size 0 and may be emitted (they add no
words); a source of size 0 is not sampled; equal rows are told apart by position, so the
result is the same multiset in any order; an empty table gives no rows; columns other
than the id, the text and the source are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.text import word_count
from millrace.operators.keys import spread
from millrace.operators.numbering import number_rows
from millrace.scratch import persist_table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: ``source, source_size, docs_before, target``.

    If the sources that stop at ``cap`` times their size are known, the others share the
    rest at one level of words per weight.  With sources sorted by size per weight the
    stopped ones come first, and the level for the right split is the largest of all
    splits, so one pass over the sources (one row each) finds it.
    """
    per_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "docs_before",
        F.coalesce(
            F.sum("docs").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
    ranked = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), turn)
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    stopped = F.coalesce(
        F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    shared = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("level", (F.col("total") - stopped).cast("double") / shared)
    return ranked.withColumn("level", F.max("level").over(everything)).select(
        "source",
        "source_size",
        "docs_before",
        F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")).alias(
            "target"
        ),
    )


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the source and the seed only."""
    name = F.concat(F.lit(seed), F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sample_copies(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with ``doc_id, source, size``.

    Positions within a source come from one range-partitioned order of all rows, so a
    source that holds a third of the rows is spread over as many tasks as its share.
    """
    targets = source_targets(sized, weights, cap).withColumnRenamed("source", "__source")
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc()]
    placed = number_rows(sized, order, "__rn", unique=True)
    rows = placed.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    place = F.col("__rn") - F.col("docs_before")
    rows = rows.withColumn(
        "__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )
    whole = F.floor("__rate")
    part = F.col("__rate") - whole
    start = offset_of(F.col("source"), seed)
    crossed = F.floor(part * place + start) - F.floor(part * (place - 1) + start)
    return rows.withColumn("copies", (whole + F.least(crossed, F.lit(1))).cast("bigint")).drop(
        "__rn", "__rate", "docs_before"
    )


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` of every document.

    The texts are read once; everything after the count of words works on a small
    table of ids, sources and sizes.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    return sample_copies(persist_table(sized, "sizes"), weights, cap, seed)


def emit_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is sampled, with its number ``copy``.

    Rows are found again by a hash of id, source and text, so null or repeated ids do no
    harm; rows equal in all three share their copies.  A column ``copy`` of ``docs`` is
    replaced.
    """
    id_, text_, source_ = F.col(doc_id), F.col(text), F.col(source)
    keys = [
        F.xxhash64(id_, F.lit(1), source_, F.lit(2), text_).alias("__key"),
        F.xxhash64(F.lit(7), text_, F.lit(1), id_, F.lit(2), source_).alias("__key2"),
    ]
    names = ["__key", "__key2"]
    sized = docs.select(
        id_.alias("doc_id"), source_.alias("source"), word_count(text_).alias("size"), *keys
    )
    picked = (
        sample_copies(persist_table(sized, "sizes"), weights, cap, seed)
        .groupBy(*names)
        .agg(F.sum("copies").alias("__sampled"), F.count(F.lit(1)).alias("__repeats"))
    )
    rows = docs.select("*", *keys).join(picked.filter("__sampled > 0"), names)
    alone = rows.filter("__repeats = 1").withColumn("__nth", F.lit(1).cast("bigint"))
    repeated = rows.filter("__repeats > 1")
    if picked.filter("__sampled > 0 AND __repeats > 1").isEmpty():
        rows = alone
    else:
        # Places in the whole table, so that a row that fills much of it is numbered by many tasks.
        placed = number_rows(repeated, names, "__place")
        first = placed.groupBy(*names, spread(names)).agg(F.min("__place").alias("__first")).select(*names, "__first")
        placed = placed.join(first, names).withColumn("__nth", F.col("__place") - F.col("__first") + 1)
        rows = alone.unionByName(placed.drop("__place", "__first"))
    share = F.expr("__sampled div __repeats") + (F.col("__nth") <= F.expr("__sampled % __repeats")).cast("bigint")
    return (
        rows.withColumn("__share", share)
        .filter("__share > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__share"))))
        .drop("__share", "__nth", "__sampled", "__repeats", *names)
    )
