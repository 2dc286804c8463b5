"""Directory trees listed, read and written by tasks; the driver never holds a list of files.

A tree is listed level by level: the folders found in one round are dealt to tasks in the next, and
each round is written to the scratch folder, so rounds grow with the depth of the tree and a lost
executor costs part of one.  Files are then dealt to tasks by their bytes and their number.
``root`` is a path or an address that Arrow's file systems open on every executor.  Names that
begin with ``.`` or ``_`` are left out, as Spark's readers do.
"""

from __future__ import annotations

import io
import os
import posixpath
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import persist_table

TASK_BYTES = 64 << 20  # of the files that one task reads
TASK_FILES = 20_000
TASK_ROWS = 250_000  # of the contents that one task sorts and writes
BATCH_BYTES = 8 << 20  # contents that a task holds before it passes them on
BATCH_ROWS = 10_000


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" not in root:
        return fs.LocalFileSystem(), root.rstrip("/")
    system, path = fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def _entries(system: fs.FileSystem, place: str) -> Iterator[tuple[str, int, bool]]:
    """Name, size and whether it is a folder, of all that a folder holds."""
    if isinstance(system, fs.LocalFileSystem):  # one at a time, as a folder may hold millions
        with os.scandir(place) as found:
            for i in found:
                folder = i.is_dir()
                yield i.name, 0 if folder else i.stat().st_size, folder
        return
    for i in system.get_file_info(fs.FileSelector(place)):
        yield i.base_name, i.size or 0, i.type == fs.FileType.Directory


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """``name, size`` of every file below ``root``; ``name`` is relative to it."""
    wanted = tuple(f".{e.lower()}" for e in extensions or ())

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        rows = []  # of many folders, as most hold little
        for batch in batches:
            for folder in batch["name"]:
                for name, size, is_folder in _entries(system, posixpath.join(base, folder) if folder else base):
                    if name[:1] in (".", "_"):
                        continue
                    rows.append((posixpath.join(folder, name), size, is_folder))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["name", "size", "folder"])
                        rows = []
        yield pd.DataFrame(rows, columns=["name", "size", "folder"])

    folders = spark.createDataFrame([("",)], "name string")
    found: list[DataFrame] = []
    while count := folders.count():
        tasks = max(spark.sparkContext.defaultParallelism, count // TASK_FILES)
        level = folders.repartition(tasks, "name").mapInPandas(listed, "name string, size bigint, folder boolean")
        level = persist_table(level, "listing")
        files = level.filter(~F.col("folder"))
        if wanted:
            ending = F.lower(F.concat(F.lit("."), F.substring_index("name", ".", -1)))
            files = files.filter(ending.isin(*wanted) & F.contains("name", F.lit(".")))
        found.append(files.select("name", "size"))
        folders = level.filter("folder").select("name")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _packed(listing: DataFrame) -> DataFrame:
    """Names dealt so that a task gets about ``TASK_BYTES`` and ``TASK_FILES`` at most."""
    total, files = listing.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES, files // TASK_FILES)
    return listing.select("name").repartition(int(tasks), "name")


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """``name, content`` of the listed files; bytes that are no UTF-8 are replaced."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        rows, held = [], 0
        for batch in batches:
            for name in batch["name"]:
                with system.open_input_stream(posixpath.join(base, name), compression=None) as file:
                    text = file.read().decode("utf-8", "replace")
                rows.append((name, text))
                held += len(text)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["name", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["name", "content"])

    return _packed(listing).mapInPandas(read, "name string, content string")


def read_lines(listing: DataFrame, root: str) -> DataFrame:
    """``name, line_no, line`` (from 0) of the listed files, which may be of any length."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        rows = []
        for batch in batches:
            for name in batch["name"]:
                with io.BufferedReader(system.open_input_file(posixpath.join(base, name)), 1 << 20) as file:
                    for i, line in enumerate(file):
                        rows.append((name, i, line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")))
                        if len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=["name", "line_no", "line"])
                            rows = []
        yield pd.DataFrame(rows, columns=["name", "line_no", "line"])

    return _packed(listing).mapInPandas(read, "name string, line_no bigint, line string")


def write_files(df: DataFrame, root: str, name: Column, content: Column, order: Sequence[str] = ()) -> int:
    """Write ``content`` to the file ``name`` below ``root``; rows of one file follow each other by ``order``.

    Returns the number of files.  A file appears whole or not at all, so a repeated task does no harm.
    Rows are dealt to tasks by their name and order, so a file of many rows is written in pieces by many tasks.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        known: set[str] = set()
        current, path, stream, draft, size, count = None, "", None, "", 0, 0
        pieces = []  # the first and the last file of a task may begin before it or go on after it

        def close(last: bool) -> None:
            if not stream:
                return
            stream.close()
            if last or count == 1:
                pieces.append((current, TaskContext.get().partitionId(), draft, size, 0))
            else:
                system.move(draft, path)

        for batch in batches:
            for to, text in zip(batch["__name"], batch["__content"], strict=True):
                if to != current:
                    close(False)
                    current, path, size, count = to, posixpath.join(base, to), 0, count + 1
                    folder = posixpath.dirname(path)
                    if folder not in known:
                        system.create_dir(folder, recursive=True)
                        known.add(folder)
                    draft = posixpath.join(folder, f".{uuid.uuid4().hex}")
                    stream = system.open_output_stream(draft, compression=None)
                data = text.encode()
                stream.write(data)
                size += len(data)
        close(True)
        pieces.append((None, 0, "", 0, count - len(pieces)))
        yield pd.DataFrame(pieces, columns=["name", "part", "draft", "size", "files"])

    named = df.select(*order, name.alias("__name"), content.alias("__content"))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, named.count() // TASK_ROWS)
    rows = named.repartitionByRange(tasks, "__name", *order).sortWithinPartitions("__name", *order)
    written = rows.select("__name", "__content").mapInPandas(
        write, "name string, part int, draft string, size bigint, files bigint"
    )
    written = persist_table(written, "written")
    moved = written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    return moved + _join_pieces(written.filter("name IS NOT NULL"), root)


def _join_pieces(pieces: DataFrame, root: str) -> int:
    """Make files of the ``draft`` files of each ``name``, in order of ``part``; returns their number.

    There are at most two pieces for each task that wrote.  Where a file system writes at any place of a file,
    each piece is copied to its place by a task of its own; elsewhere a file has one writer, which holds a block.
    """
    local = isinstance(open_root(root)[0], fs.LocalFileSystem)
    of_file = Window.partitionBy("name").orderBy("part")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        "name", "part", "draft",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"),
        F.first("draft").over(of_file).alias("whole"),
        F.count(F.lit(1)).over(Window.partitionBy("name")).alias("pieces"),
    )
    placed = persist_table(placed, "pieces")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for draft, whole, at in zip(batch["draft"], batch["whole"], batch["at"], strict=True):
                with open(draft, "rb") as source, open(whole, "r+b") as target:
                    target.seek(at)
                    shutil.copyfileobj(source, target, BATCH_BYTES)
        yield pd.DataFrame({"done": [True]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _append(open_root(root)[0], ((d, w) for b in batches for d, w in zip(b["draft"], b["whole"], strict=True)))
        yield pd.DataFrame({"done": [True]})

    many = placed.filter("pieces > 1")
    if local:
        later = many.filter("draft <> whole")
        if count := later.count():
            later.repartition(count, "draft").mapInPandas(copy, "done boolean").count()
    else:
        many.repartition("name").sortWithinPartitions("name", "part").mapInPandas(join, "done boolean").count()

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        files = 0
        for batch in batches:
            for name, draft, whole, pieces in zip(batch["name"], batch["draft"], batch["whole"], batch["pieces"], strict=True):
                if draft == whole:  # the first piece
                    files += 1
                    made = whole if local or pieces == 1 else f"{whole}-whole"
                    if system.get_file_info(made).type != fs.FileType.NotFound:  # else an earlier try moved it
                        system.move(made, posixpath.join(base, name))
                if system.get_file_info(draft).type != fs.FileType.NotFound:
                    system.delete_file(draft)
        yield pd.DataFrame({"files": [files]})

    done = placed.select("name", "draft", "whole", "pieces").mapInPandas(settle, "files bigint")
    return done.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def _append(system: fs.FileSystem, pieces: Iterator[tuple[str, str]]) -> None:
    """Write the drafts of a file, which follow each other, to one next to the first."""
    target = None
    for draft, whole in pieces:
        if draft == whole:
            if target:
                target.close()
            target = system.open_output_stream(f"{whole}-whole", compression=None)
        with system.open_input_stream(draft, compression=None) as source:
            while block := source.read(BATCH_BYTES):
                target.write(block)
    if target:
        target.close()
