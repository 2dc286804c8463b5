"""Joins over keyed tables, paths and small lookup tables.

No side is broadcast by hint here: the planner broadcasts a side whose size it knows to
be below ``spark.sql.autoBroadcastJoinThreshold`` and adaptive execution splits hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import listing_time
from millrace.operators.keys import key_set
from millrace.sources.generated import rows_literal

# Memory in GB and cores by instance type; unknown types get the defaults.
INSTANCE_TYPES: dict[str, tuple[float, int]] = {
    "t2.micro": (1, 1),
    "t2.small": (2, 1),
    "t2.medium": (4, 2),
    "m3.medium": (3.75, 1),
    "m3.large": (7.5, 2),
    "m3.xlarge": (15, 4),
    "m3.2xlarge": (30, 8),
    "c3.large": (3.75, 2),
    "c3.xlarge": (7.5, 4),
    "c3.2xlarge": (15, 8),
    "c3.4xlarge": (30, 16),
    "c3.8xlarge": (60, 32),
    "r3.large": (15.25, 2),
    "r3.xlarge": (30.5, 4),
    "r3.2xlarge": (61, 8),
    "r3.4xlarge": (122, 16),
    "r3.8xlarge": (244, 32),
    "i2.xlarge": (30.5, 4),
    "i2.2xlarge": (61, 8),
    "i2.4xlarge": (122, 16),
    "i2.8xlarge": (244, 32),
    "g2.2xlarge": (15, 8),
    "hs1.8xlarge": (117, 16),
}
DEFAULT_MEMORY_MB = 1024
DEFAULT_CORES = 1

# The client that goes with each kind of backend.
BACKEND_CLIENTS: dict[str, str] = {
    "openmpi": "mpi-client",
    "yarn": "hadoop-client",
    "spark": "spark-client",
    "gluster": "mpi-client",
    "cassandra": "cassandra-client",
    "titan": "cassandra-client",
    "hadoop": "hadoop-client",
    "hive": "hadoop-client",
    "mongodb": "mongo-client",
}


def join_actual_predicted(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("user", "item")
) -> DataFrame:
    """Ratings with their predictions; keys kept as floats on one side compare as integers."""
    as_int = {k: F.col(k).cast("bigint") for k in keys}
    return actual.withColumns(as_int).join(predicted.withColumns(as_int), list(keys))


def snapshots_with_base(snapshots: DataFrame, clusters: DataFrame) -> DataFrame:
    """Snapshots with the base image of their cluster; snapshots of unknown clusters go."""
    base = clusters.select(F.col("uuid").alias("cluster_uuid"), "base")
    return snapshots.join(base, "cluster_uuid").select(
        F.col("snapshot_uuid").alias("uuid"),
        "base",
        listing_time(F.col("snapshot_ts")).alias("snapshot_ts"),
    )


def stacks_with_snapshot_time(
    stacks: DataFrame, snapshots: DataFrame, ts: str = "ts"
) -> DataFrame:
    """All stacks; the formatted stack time shows only where its snapshot exists, else blank."""
    known = key_set(snapshots, ["snapshot_uuid"]).withColumn("__known", F.lit(True))
    shown = F.when(F.col("__known"), listing_time(F.col(ts))).otherwise(F.lit(""))
    return stacks.join(known, "snapshot_uuid", "left").withColumn(ts, shown).drop("__known")


def lookup_with_default(
    df: DataFrame, dimension: DataFrame, key: str, defaults: Mapping[str, Any]
) -> DataFrame:
    """Left lookup in a dimension with unique keys; absent keys take the defaults."""
    joined = df.join(dimension.select(key, *defaults), key, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    )


def instance_dimension(spark: SparkSession) -> DataFrame:
    """The fixed instance table as ``instance_type, mem_mb, cores``."""
    rows = [(k, int(mem * 1024), cores) for k, (mem, cores) in INSTANCE_TYPES.items()]
    return rows_literal(spark, rows, "instance_type string, mem_mb int, cores int")


def required_installed(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Items whose key is on the wanted list."""
    return items.join(key_set(wanted, [key]), key, "left_semi")


def missing_items(declared: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct declared keys that are not present."""
    return declared.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def path_prefix_join(
    parents: DataFrame, children: DataFrame, parent_dir: str, child_dir: str
) -> DataFrame:
    """Pairs where the parent's segments lead the child's; blank parent segments match anything.

    Parents fall into few shapes (number of segments and which of them are blank).  Each
    child yields one masked key per shape that fits it, so the pairs come from one
    equality join whose output is exactly the result.
    """
    segments = F.split(F.col(parent_dir), "/")
    blanks = F.array_join(F.transform(segments, lambda s: F.when(s == "", "0").otherwise("1")), "")
    left = parents.withColumn("__shape", blanks).withColumn("__key", _masked(segments, blanks))

    parts = F.split(F.col(child_dir), "/")
    right = _fitting_shapes(left.select("__shape").distinct(), children, parts)
    right = right.withColumn("__key", _masked(parts, F.col("__shape")))
    return left.join(right, ["__shape", "__key"]).drop("__shape", "__key")


def _fitting_shapes(shapes: DataFrame, children: DataFrame, parts: Column) -> DataFrame:
    """One row per child and parent shape no longer than the child's own path."""
    lengths = children.withColumn("__length", F.explode(F.sequence(F.lit(1), F.size(parts))))
    return lengths.join(shapes.withColumn("__length", F.length("__shape")), "__length").drop("__length")


def _masked(segments: Column, shape: Column) -> Column:
    """The leading segments, as many as the shape has, with its blank ones left out."""
    lead = F.slice(segments, F.lit(1), F.length(shape))
    kept = F.transform(
        lead, lambda s, i: F.when(F.substr(shape, i + 1, F.lit(1)) == "0", "").otherwise(s)
    )
    return F.array_join(kept, "/")


def client_services_for_backends(
    df: DataFrame, types: str, clients: Mapping[str, str] = BACKEND_CLIENTS
) -> DataFrame:
    """Distinct clients of an array of backend types, and the known types with duplicates."""
    table = F.create_map(*[F.lit(x) for pair in clients.items() for x in pair])
    known = F.filter(F.col(types), lambda t: F.map_contains_key(table, t))
    return df.withColumn("service_names", known).withColumn(
        "client_services",
        F.array_sort(F.array_distinct(F.transform("service_names", lambda t: table[t]))),
    )
