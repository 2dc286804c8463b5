"""One JSON document of any size, read by many tasks.

A file is cut into byte ranges.  Whether a range begins inside a string, and how deep, depends on all bytes
before it; so a first pass finds for each range, and each state it may begin in, the state it ends in and
how far the depth moves.  These small maps are composed in order.  In a second pass each task knows
where it stands, finds the elements that begin in its range, and reads on where the last one ends.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.json_scan import string_value
from millrace.scratch import persist_table
from millrace.sources import trees

CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20

# States in which a range may begin: outside of strings, inside of one, and there behind a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)

_STEP = np.zeros(256, np.int64)
_STEP[[0x7B, 0x5B]] = 1
_STEP[[0x7D, 0x5D]] = -1
_NAME = re.compile(rb'("(?:[^"\\]|\\.)*+")[ \t\r\n]*:[ \t\r\n]*\Z', re.S)


class Marks(NamedTuple):
    """Brackets outside of strings, and how the range ends."""

    places: np.ndarray
    steps: np.ndarray
    end: int


def marks_of(data: bytes, state: int) -> Marks:
    flat = np.frombuffer(data, np.uint8)
    at = np.arange(len(flat))
    # A quote counts unless an odd number of backslashes stands before it; one may stand before the range.
    plain = np.maximum.accumulate(np.where(flat != 0x5C, at, -1)) if len(flat) else at
    quotes = np.flatnonzero(flat == 0x22)
    before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1) if len(quotes) else quotes
    run = quotes - 1 - before + ((before < 0) & (state == ESCAPED))
    quotes = quotes[run % 2 == 0]
    steps = _STEP[flat]
    places = np.flatnonzero(steps)
    inside = (np.searchsorted(quotes, places) + (state != OUTSIDE)) % 2 == 1
    places = places[~inside]
    end = (len(quotes) + (state != OUTSIDE)) % 2
    if end == INSIDE:
        last = plain[-1] if len(flat) else -1
        if (len(flat) - 1 - last + (last < 0 and state == ESCAPED)) % 2:
            end = ESCAPED
    return Marks(places, steps[places], int(end))


def _read(system, path: str, begin: int, size: int) -> bytes:
    with system.open_input_file(path) as file:
        file.seek(begin)
        return file.read(size)


def array_elements(spark: SparkSession, root: str, depth: int = 3, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``file, array, element``: the objects in all arrays at ``depth`` of the documents below ``root``, as JSON text.

    ``depth`` counts the brackets around the elements, and ``array`` is the name before the innermost
    one.  Elements that are no objects are left out, and what stands outside of arrays too.
    """
    listing = persist_table(trees.list_files(spark, root), "documents")
    chunks = listing.filter("size > 0").select(
        "name", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {chunk_bytes}"))).alias("chunk")
    )
    count = chunks.count()
    tasks = max(min(count, 4 * spark.sparkContext.defaultParallelism), count // 16, 1)
    chunks = chunks.repartition(tasks, "name", "chunk")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = trees.open_root(root)
        for batch in batches:
            out = []
            for name, chunk in zip(batch["name"], batch["chunk"], strict=True):
                data = _read(system, posixpath.join(base, name), chunk * chunk_bytes, chunk_bytes)
                ends = [marks_of(data, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
                out.append((name, chunk, [m.end for m in ends], [int(m.steps.sum()) for m in ends]))
            yield pd.DataFrame(out, columns=["name", "chunk", "ends", "moves"])

    maps = chunks.mapInPandas(summarise, "name string, chunk bigint, ends array<int>, moves array<bigint>")
    maps = persist_table(maps, "ranges")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, level, out = OUTSIDE, 0, []
        for name, chunk, ends, moves in rows.itertuples(index=False):
            out.append((name, chunk, state, level))
            state, level = int(ends[state]), level + int(moves[state])
        if state != OUTSIDE or level:
            raise ValueError(f"{out[-1][0]} is no whole JSON document")
        return pd.DataFrame(out, columns=["name", "chunk", "state", "level"])

    # One short row for each range of a file.
    starts = maps.groupBy("name").applyInPandas(compose, "name string, chunk bigint, state int, level bigint")
    starts = persist_table(starts, "starts").repartition(tasks, "name", "chunk")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = trees.open_root(root)
        columns = ["name", "chunk", "at", "array", "element"]
        for batch in batches:
            rows, held = [], 0
            for name, chunk, state, level in batch.itertuples(index=False):
                for row in _elements(system, posixpath.join(base, name), chunk, state, level, depth, chunk_bytes):
                    rows.append((name, chunk, *row))
                    held += len(row[2] or "")
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    found = starts.mapInPandas(find, "name string, chunk bigint, at bigint, array string, element string")
    found = persist_table(found, "elements")
    # The array that is open where a range begins is the last one opened before it.
    opened = found.filter("element IS NULL").groupBy("name", "chunk").agg(F.max_by("array", "at").alias("last"))
    earlier = Window.partitionBy("name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = starts.join(opened, ["name", "chunk"], "left").select(
        "name", "chunk", F.last("last", ignorenulls=True).over(earlier).alias("open")
    )
    elements = found.filter("element IS NOT NULL").join(known, ["name", "chunk"])
    return elements.select(F.col("name").alias("file"), F.nullif(F.coalesce("array", "open"), F.lit("")).alias("array"), "element")


def _elements(system, path: str, chunk: int, state: int, level: int, depth: int, size: int) -> Iterator[tuple]:
    """``place, array, element`` of the elements that begin in a range, and ``place, array, None`` for each array."""
    begin = chunk * size
    data = _read(system, path, begin, size)
    marks = marks_of(data, state)
    levels = level + np.cumsum(marks.steps)
    flat = np.frombuffer(data, np.uint8)[marks.places]
    array = None
    closes = np.flatnonzero((levels == depth) & (marks.steps < 0))
    for i in np.flatnonzero((marks.steps > 0) & ((levels == depth) | (levels == depth + 1))):
        place = int(marks.places[i])
        if levels[i] == depth:
            if flat[i] == 0x5B:
                array = _name_before(system, path, begin + place) or ""
                yield place, array, None
            continue
        if flat[i] != 0x7B:
            continue
        after = closes[np.searchsorted(closes, i)] if len(closes) and closes[-1] > i else None
        if after is not None:
            text = data[place : int(marks.places[after]) + 1]
        else:
            text = data[place:] + _rest(system, path, begin + len(data), marks.end, int(levels[-1]), depth, size)
        yield place, array, text.decode("utf-8", "replace")


def _rest(system, path: str, at: int, state: int, level: int, depth: int, size: int) -> bytes:
    """What belongs to the element that is open at ``at``."""
    parts = []
    while True:
        data = _read(system, path, at, size)
        if not data:
            raise ValueError(f"{path} ends inside of an element")
        marks = marks_of(data, state)
        levels = level + np.cumsum(marks.steps)
        ends = np.flatnonzero((levels == depth) & (marks.steps < 0))
        if len(ends):
            return b"".join([*parts, data[: int(marks.places[ends[0]]) + 1]])
        parts.append(data)
        at, state, level = at + len(data), marks.end, int(levels[-1]) if len(levels) else level


def _name_before(system, path: str, at: int) -> str | None:
    """The name of the member whose value begins at ``at``; null if it has none."""
    size = 256
    while True:
        data = _read(system, path, max(at - size, 0), min(size, at))
        found = _NAME.search(data)
        if found and (found.start() > 0 or at <= size):
            return string_value(found[1].decode("utf-8", "replace"))
        if at <= size or data.rstrip()[-1:] != b":":
            return None
        size *= 4


def elements_as(elements: DataFrame, array: str, schema: str) -> DataFrame:
    """The elements of one array as rows with a declared schema."""
    rows = elements.filter(F.col("array") == array)
    return rows.select(F.from_json("element", schema).alias("e")).select("e.*")

