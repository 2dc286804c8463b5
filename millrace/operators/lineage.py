"""Ancestry of records that each name one base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import persist_table

MAX_ROUNDS = 40


def base_lineage(edges: DataFrame, child: str = "child", base: str = "base") -> DataFrame:
    """``child, ancestor, depth`` for every ancestor of every child.

    Known chains are doubled each round, so a chain of length ``d`` takes about
    ``log2(d)`` rounds; each round is written to the shared scratch folder.  A cycle is
    reported as an error.
    """
    first = edges.select(
        F.col(child).alias("child"), F.col(base).alias("ancestor"), F.lit(1).alias("depth")
    )
    known = persist_table(first.distinct(), "lineage")
    reach = 1
    for _ in range(MAX_ROUNDS):
        ends = known.filter(F.col("depth") == reach).select(
            "child", F.col("ancestor").alias("__via"), F.col("depth").alias("__steps")
        )
        onward = known.select(F.col("child").alias("__via"), "ancestor", "depth")
        longer = ends.join(onward, "__via").select(
            "child", "ancestor", (F.col("__steps") + F.col("depth")).alias("depth")
        )
        longer = persist_table(longer, "lineage")
        grown, cyclic = longer.agg(
            F.count(F.lit(1)), F.count_if(F.col("child") == F.col("ancestor"))
        ).first()
        if cyclic:
            raise ValueError("the bases form a cycle")
        if not grown:
            return known
        known = known.unionByName(longer)
        reach *= 2
    raise ValueError(f"chains longer than 2^{MAX_ROUNDS}")


def build_order(edges: DataFrame, child: str = "child", base: str = "base") -> DataFrame:
    """Each record once with its build step: a base always comes before what rests on it.

    Every record points at an ancestor and knows how far it is.  Each round it takes over
    the pointer of the record it points at, so a chain of length ``d`` takes about
    ``log2(d)`` rounds with one row per record and base; each round is written to the
    shared scratch folder.  A cycle is reported as an error.
    """
    first = edges.select(
        F.col(child).alias("child"), F.col(base).alias("__at"), F.lit(1).cast("bigint").alias("depth")
    )
    state = persist_table(first.distinct(), "order")
    records = state.count()
    reach = 1
    while True:
        onward = state.select(
            F.col("child").alias("__at"), F.col("__at").alias("__next"), F.col("depth").alias("__more")
        )
        moved = state.join(onward, "__at", "left").select(
            "child",
            F.coalesce("__next", "__at").alias("__at"),
            (F.col("depth") + F.coalesce("__more", F.lit(0))).alias("depth"),
            F.col("__next").isNotNull().alias("__moved"),
        )
        moved = persist_table(
            moved.groupBy("child", "__at").agg(
                F.max("depth").alias("depth"), F.bool_or("__moved").alias("__moved")
            ),
            "order",
        )
        if moved.filter("__moved").isEmpty():
            break
        if reach > records:
            raise ValueError("the bases form a cycle")
        state, reach = moved.drop("__moved"), 2 * reach
    own = state.groupBy("child").agg(F.max("depth").cast("int").alias("step"))
    placed = own.select(F.col("child").alias("name"), "step")
    roots = edges.select(F.col(base).alias("name")).distinct()
    return placed.unionByName(
        roots.join(placed, "name", "left_anti").withColumn("step", F.lit(0))
    )
