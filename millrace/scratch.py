"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

Iterative jobs cut their lineage here, and jobs that need a second pass over a
sorted layout read it back from here, so the work survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}  # stand-ins for the setting in local sessions, by application


_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)
_OWNED: dict[tuple[str, str], list[str]] = {}  # paths by application and owner


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application below the shared checkpoint folder."""
    root = spark.conf.get(_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="millrace-")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no earlier call returned."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and return a frame that reads the files back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if owner := _OWNER.get():
        _OWNED.setdefault((spark.sparkContext.applicationId, owner), []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables that ``persist_table`` writes in here belong to ``owner``, who can release them at once."""
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_owned(spark: SparkSession, owner: str) -> None:
    """Delete the tables of ``owner``; frames that read them become invalid."""
    for folder in _OWNED.pop((spark.sparkContext.applicationId, owner), []):
        delete_folder(spark, folder)


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; frames that read them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def release_table(df: DataFrame) -> None:
    """Delete the files of a frame that ``persist_table`` returned; nothing may read it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if spark.sparkContext.applicationId not in folder:
            raise ValueError(f"{folder} is no scratch table")
        delete_folder(spark, folder)
