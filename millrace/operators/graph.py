"""Property-graph jobs on a vertex table and an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import stable_hash
from millrace.scratch import persist_table

MAX_ROUNDS = 40


def traverse_out(
    vertices: DataFrame, edges: DataFrame, start: Column, label: str, prop: str
) -> DataFrame:
    """``_id`` of each start vertex and ``prop`` of the vertices its labelled edges lead to.

    Parallel edges give repeated rows.
    """
    sources = vertices.filter(start).select("_id")
    out = edges.filter(F.col("_label") == label).select(F.col("_outV").alias("_id"), "_inV")
    targets = vertices.select(F.col("_id").alias("_inV"), prop)
    return sources.join(out, "_id").join(targets, "_inV").select("_id", prop)


def out_ids(edges: DataFrame, vertex: int) -> DataFrame:
    """Ids of the vertices that the edges of one vertex lead to."""
    return edges.filter(F.col("_outV") == vertex).select("_inV")


def in_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Incoming edges of every vertex, zero included; edges are counted before the join."""
    counted = edges.groupBy(F.col("_inV").alias("_id")).agg(F.count(F.lit(1)).alias("__n"))
    return vertices.select("_id").join(counted, "_id", "left").select(
        "_id", F.coalesce("__n", F.lit(0)).cast("bigint").alias("degree")
    )


def generate_attachment_graph(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``src, dst`` of ``n`` edges: vertex ``i`` joins an endpoint drawn from all earlier ones.

    The list of endpoints before edge ``i`` holds vertex 0 and both ends of the edges
    before it.  A draw that lands on the newer end of an edge names a vertex at once; one
    that lands on the older end stands for whatever that edge drew.  Such references are
    followed for all edges together, twice as far each round, so the number of rounds
    grows with the logarithm of the longest chain.  (Copy model after Batagelj and Brandes.)
    """
    ids = spark.range(1, n + 1).withColumnRenamed("id", "src")
    draws = ids.withColumn(
        "__slot", F.pmod(stable_hash(seed, F.col("src")), F.lit(2) * F.col("src") - 1)
    )
    even = F.col("__slot") % 2 == 0
    state = draws.select(
        "src",
        F.when(even, F.expr("__slot div 2")).alias("dst"),
        F.when(~even, F.expr("(__slot + 1) div 2")).alias("via"),
    )
    state = persist_table(state, "attachment")
    finished = state.filter("via IS NULL")
    for _ in range(MAX_ROUNDS):
        waiting = state.filter("via IS NOT NULL").select("src", "via")
        step = state.select(
            F.col("src").alias("via"), F.col("dst").alias("dst"), F.col("via").alias("__next")
        )
        moved = waiting.join(step, "via").select("src", "dst", F.col("__next").alias("via"))
        moved = persist_table(moved, "attachment")
        finished = finished.unionByName(moved.filter("via IS NULL"))
        if moved.filter("via IS NOT NULL").limit(1).count() == 0:
            return finished.select("src", "dst")
        state = finished.unionByName(moved.filter("via IS NOT NULL"))
    raise RuntimeError("references did not resolve")
