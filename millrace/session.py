"""Session helpers: a local session for bench and tests, and settings sized for a cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app_name: str = "millrace", cpus: int | None = None, **conf: str) -> SparkSession:
    """A ``local[cpus]`` session tuned for small data, with the web page switched off."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, cores: int, split_mb: int = 256, shuffle_mb: int = 200) -> dict[str, str]:
    """Settings for a job over ``input_bytes`` of files on ``cores`` executor cores.

    Scan splits and shuffle partitions get a fixed size, whatever the total; adaptive
    execution then merges small shuffle partitions and splits the partitions of hot keys,
    also where that costs one more shuffle.
    """
    shuffles = max(input_bytes // (shuffle_mb << 20), 2 * cores)
    return {
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.shuffle.partitions": str(shuffles),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{shuffle_mb}m",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }
