"""Remove byte strings of a given length that occur more than once, by a distributed suffix sort.

A byte is removed if it lies in a window of ``length`` bytes whose content also starts
anywhere else, in the same document or another; windows never cross documents and are
judged on the input.

1. Each window is represented by one suffix inside it, chosen by content, so that equal
   windows choose alike; one suffix stands for some 75 neighbouring windows.  Suffixes whose
   mark (a hash of their first bytes) occurs once cannot matter and stay at home.
2. The others are sorted in each task, with the mark in front, and sent to the task of
   their mark as front-coded runs: only what differs from the suffix before travels, deflated.
3. Each task merges its runs with a loser tree that knows the prefixes the heads share with
   the last suffix and never compares them again.  The merge yields the prefix that neighbours
   share, which with the bytes before the suffixes tells for every window whether it occurs twice.
4. Spans go back to their documents, joined by id and a hash of the text.

Passages that many documents share must not meet in one task:

* Suffixes with equal contexts (all bytes of their windows) are counted, map-side first.  Two or
  more are all repeated; one of them stands for the rest in the sort.
* A mark that still has more than ``HOT`` suffixes is split: its windows are cut into blocks, and
  the bytes that all windows of a block share make the mark of the block, so equal windows still
  meet.  Equal blocks are counted as above, and what stays hot is cut again, in the end
  to single windows, where counting decides.

Cases: null texts are empty; texts below ``length`` bytes stay whole; very long texts are
marked in segments, equal rows repeat each other and are removed; rows with null or equal ids
are told apart by their text; an empty table gives no rows; other columns pass through, and
columns named like results are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.suffixes import GRAM, front_code, front_decode, marked_suffixes, merge, repeated_windows
from millrace.operators.keys import spread
from millrace.scratch import persist_table, release_table

LENGTH = 200
BUCKET_ROWS = 40_000  # suffixes that one merge expects
RUN_ROWS = 40_000  # suffixes that a task sorts at a time
HOT = BUCKET_ROWS  # suffixes of one mark that go to one merge; larger groups are split by content
MEMBERS = 32  # suffixes that travel as one row, about
WIDTHS = (16, 1)  # windows in a block, by round of splitting

RUNS = (
    "bucket bigint, shared array<int>, sizes array<int>, rest binary, id array<bigint>, check array<bigint>, "
    "place array<bigint>, nearest array<int>, farthest array<int>, before binary"
)
SPANS = "id bigint, check bigint, `begin` bigint, `end` bigint"
BLOCKS = "mark bigint, context bigint, id bigint, check bigint, place bigint, nearest int, farthest int"


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "__id": F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(whole)),
            "__check": F.xxhash64(F.lit("check"), whole),
        }
    )


def marks(docs: DataFrame, text: str, length: int) -> DataFrame:
    """The suffixes that stand for all windows, as in ``BLOCKS``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, check, t in zip(batch["__id"], batch["__check"], batch["text"], strict=True):
                mark, place, first, last, context = marked_suffixes((t or "").encode("utf-8", "replace"), length)
                if n := len(mark):
                    out.append((mark, context, np.full(n, i), np.full(n, check), place, place - last, place - first))
            columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 7
            names = ["mark", "context", "id", "check", "place", "nearest", "farthest"]
            yield pd.DataFrame({n: np.concatenate(list(c)) for n, c in zip(names, columns, strict=True)})

    rows = docs.select("__id", "__check", F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    return rows.mapInPandas(find, BLOCKS)


def _runs(buckets: int, length: int):
    """Cut the suffixes of some documents out of their texts and send them as sorted runs."""

    def code(rows: list[tuple]) -> Iterator[dict]:
        rows.sort(key=lambda r: (r[0], r[1]))
        begin = 0
        while begin < len(rows):
            end = begin
            while end < len(rows) and rows[end][0] == rows[begin][0]:
                end += 1
            part = rows[begin:end]
            shared, rest = front_code([r[1] for r in part])
            yield {
                "bucket": part[0][0], "shared": shared, "sizes": [len(x) for x in rest], "rest": zlib.compress(b"".join(rest), 1),
                "id": [r[2] for r in part], "check": [r[3] for r in part], "place": [r[4] for r in part],
                "nearest": [r[5] for r in part], "farthest": [r[6] for r in part],
                "before": zlib.compress(b"".join(r[7] for r in part), 1),
            }
            begin = end

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for i, check, t, found in zip(batch["__id"], batch["__check"], batch["text"], batch["found"], strict=True):
                data = t.encode("utf-8", "replace")
                for s in {(s["mark"], s["place"], s["nearest"], s["farthest"]) for s in found}:
                    mark, place, nearest, farthest = s
                    head = (mark & (1 << 64) - 1).to_bytes(8, "big")
                    suffix = data[place : place - nearest + length]
                    before = data[place - farthest : place][::-1]
                    rows.append((mark % buckets, head + suffix, i, check, place, nearest, farthest, before))
            if len(rows) >= RUN_ROWS:
                yield pd.DataFrame(list(code(rows)))
                rows = []
        if rows:
            yield pd.DataFrame(list(code(rows)))

    return cut


def _merge(length: int):
    """Merge the runs of a bucket; gives the spans of the repeated windows."""

    def spans(group: pd.DataFrame) -> pd.DataFrame:
        runs = []
        for sizes, packed, shared in zip(group["sizes"], group["rest"], group["shared"], strict=True):
            rest = zlib.decompress(packed)
            ends = np.cumsum(sizes).tolist()
            runs.append(front_decode(list(shared), [rest[a:b] for a, b in zip([0, *ends], ends, strict=False)]))
        order = merge(runs)
        offset = np.r_[0, np.cumsum([len(r.texts) for r in runs])]
        at = np.array([offset[r] + i for r, i, _ in order], np.int64)
        shared = np.array([n for _, _, n in order], np.int64) - 8
        column = {n: np.concatenate(list(group[n])).astype(np.int64)[at] for n in ("id", "check", "place", "nearest", "farthest")}
        farthest = np.concatenate(list(group["farthest"])).astype(np.int64)
        flat = np.frombuffer(b"".join(map(zlib.decompress, group["before"])), np.uint8)
        left = np.zeros((len(at), length - GRAM), np.uint8)
        left[np.arange(left.shape[1]) < farthest[:, None]] = flat
        found = repeated_windows(shared, left[at], column["nearest"], column["farthest"], length)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        place = column["place"][row]
        return pd.DataFrame(
            {
                "id": column["id"][row],
                "check": column["check"][row],
                "begin": place - (high - 1),
                "end": place - low + length,
            }
        )

    return spans


def _number(content: bytes, *more: int) -> int:
    """One 64-bit number for some bytes and numbers."""
    packed = struct.pack(f"<{len(more)}q", *more) + content
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)


def _blocks(width: int, length: int):
    """Cut the windows of suffixes into blocks of ``width``, marked by the bytes that a block's windows share."""
    names = ["mark", "context", "id", "check", "place", "nearest", "farthest"]

    def blocks(found: list) -> Iterator[tuple]:
        for s in {(s["mark"], s["place"], s["nearest"], s["farthest"]) for s in found}:
            mark, place, nearest, farthest = s
            for b in range(nearest // width, farthest // width + 1):
                begin, end = b * width, b * width + width - 1
                yield mark, b, place, place - begin, place - end + length, max(nearest, begin), min(farthest, end)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for i, check, t, found in zip(batch["__id"], batch["__check"], batch["text"], batch["found"], strict=True):
                data = t.encode("utf-8", "replace")
                for mark, b, place, begin, end, low, high in blocks(found):
                    key = _number(data[begin:end], mark, b)
                    context = _number(data[place - high : place - low + length], low, high)
                    out.append((key, context, i, check, place, low, high))
                    if len(out) >= RUN_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        yield pd.DataFrame(out, columns=names)

    return cut


def _by_doc(suffixes: DataFrame) -> DataFrame:
    suffix = F.struct("mark", "place", "nearest", "farthest")
    return suffixes.groupBy("id", "check").agg(F.collect_set(suffix).alias("found"))


def _with_texts(keyed: DataFrame, text: str, by_doc: DataFrame) -> DataFrame:
    texts = keyed.select("__id", "__check", F.col(text).alias("text"))
    rows = texts.join(by_doc, (F.col("__id") == F.col("id")) & (F.col("__check") == F.col("check")))
    return rows.select("__id", "__check", "text", "found")


def _unlike(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the suffixes with equal contexts, and one suffix of each context.

    The suffixes come with ``size``, how many their mark has left; one alone is left out.
    ``rows`` has ``part``, which deals out the suffixes of a context.
    """
    # The suffixes of one context and part travel as one row; the verdict goes back to these rows by
    # keys that occur once.
    suffix = F.struct("id", "check", "place", "nearest", "farthest")
    local = rows.groupBy("mark", "context", "part").agg(F.collect_list(suffix).alias("members"))
    local = persist_table(local, "local")
    contexts = local.groupBy("mark", "context", spread(["mark", "context"])).agg(
        F.sum(F.size("members")).alias("copies"),
        F.min(F.array_min("members")).alias("one"),
        F.collect_list("part").alias("parts"),
    )
    contexts = persist_table(contexts.select("mark", "context", "copies", "one", "parts"), "contexts")
    repeated = contexts.filter("copies > 1").select("mark", "context", F.explode("parts").alias("part"))
    copied = local.join(repeated, ["mark", "context", "part"]).select(F.inline("members"))
    begin, end = F.col("place") - F.col("farthest"), F.col("place") - F.col("nearest") + length
    sizes = contexts.groupBy("mark", spread(["mark"])).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    unlike = contexts.join(sizes.select("mark", "size"), "mark").select("mark", "one.*", "size")
    return copied.select("id", "check", begin.alias("begin"), end.alias("end")), unlike


def unlike_suffixes(keyed: DataFrame, text: str, length: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Suffixes to merge, at most ``most`` of a mark, and spans that are known to be repeated."""
    every = persist_table(marks(keyed, text, length), "marks")
    twice = every.select("mark", spread(["mark"])).groupBy("mark", "__spread").count().filter("count > 1")
    # All suffixes of a mark come from one task of this join, so those of a passage of many documents
    # are dealt by their documents to parts of some size.
    part = F.pmod(F.xxhash64("id", "check", "place"), F.expr(f"(count - 1) div {MEMBERS} + 1"))
    shared = every.join(twice.select("mark", "count"), "mark").withColumn("part", part).drop("count")
    shared = persist_table(shared, "shared")
    release_table(every)
    known, unlike = _unlike(shared, length)
    spans, left = [known], [unlike.filter(F.col("size") <= most).drop("size")]
    for width in WIDTHS:
        hot = unlike.filter(F.col("size") > most).drop("size")
        if hot.isEmpty():
            break
        blocks = _with_texts(keyed, text, _by_doc(hot)).mapInPandas(_blocks(min(width, length), length), BLOCKS)
        blocks = persist_table(blocks.withColumn("part", F.spark_partition_id().cast("bigint")), "blocks")
        known, unlike = _unlike(blocks, length)
        spans.append(known)
        if width > 1:  # else all suffixes of a mark are one window
            left.append(unlike.filter(F.col("size") <= most).drop("size"))
    return left, spans


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = HOT
) -> DataFrame:
    """``id, check, begin, end``: byte spans covered by repeated windows (they may touch or overlap)."""
    keyed = _keyed(docs.select(doc_id, text), doc_id, text)
    left, known = unlike_suffixes(keyed, text, length, most)
    suffixes = left[0]
    for rows in left[1:]:
        suffixes = suffixes.unionByName(rows)
    by_doc = persist_table(_by_doc(suffixes), "suffixes")
    total = by_doc.agg(F.sum(F.size("found"))).first()[0] or 0
    buckets = -(-total // BUCKET_ROWS) or 1
    runs = _with_texts(keyed, text, by_doc).mapInPandas(_runs(buckets, length), RUNS)
    spans = runs.groupBy("bucket").applyInPandas(_merge(length), SPANS)
    for more in known:
        spans = spans.unionByName(more)
    return spans


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    keep_text: bool = True,
    most: int = HOT,
) -> DataFrame:
    """Add ``n_bytes, n_removed, n_spans, kept_sha256``, and ``kept_text`` unless it is not wanted.

    ``kept_text`` drops the parts of characters whose other bytes were removed.
    """
    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]

    @F.pandas_udf(fields + (", kept_text string" if keep_text else ""))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for t, spans in zip(texts, found, strict=True):
                data = (t or "").encode("utf-8", "replace")
                gone = merge_spans(spans) if spans is not None and len(spans) else []
                kept, at = [], 0
                for begin, end in gone:
                    kept.append(data[at:begin])
                    at = end
                rest = b"".join([*kept, data[at:]])
                row = (len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest.decode("utf-8", "ignore")) if keep_text else row)
            yield pd.DataFrame(out, columns=names)

    spans = repeated_spans(docs, doc_id, text, length, most)
    spans = spans.groupBy("id", "check").agg(F.collect_set(F.struct("begin", "end")).alias("__spans"))
    rows = _keyed(docs, doc_id, text).join(
        spans.withColumnsRenamed({"id": "__id", "check": "__check"}), ["__id", "__check"], "left"
    )
    rows = rows.withColumn("__cut", cut(F.col(text), F.col("__spans")))
    return rows.withColumns({n: F.col("__cut")[n] for n in names}).drop("__cut", "__spans", "__id", "__check")
