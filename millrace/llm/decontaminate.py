"""Benchmark passages in documents, found by pigeonhole pieces and bit-parallel edit distance.

Texts are compared in lower case with each run of white space as one space.  An item of
``m`` characters may differ by ``m * error_rate`` edits (insertions, deletions, changes).
Cut into one piece more than that budget, at least one piece must occur unchanged, so the
exact hits of all pieces (one pass of a multi-pattern automaton over the whole text) give
every place worth a look; Myers' bit-parallel distance then decides.  Places that touch are
joined before, so a text is verified at most once per item that it hits.

The benchmark is the query set.  Its bytes are summed first and it goes out in blocks of
about ``block_bytes``, one pass over the documents per block; nothing else is broadcast and
nothing is shuffled.

Cases: null and empty texts and items match nothing; an item shorter than ``min_chars``
must occur unchanged; repeated items match under each of their ids; repeated documents give
repeated rows; empty tables give no rows; other columns do not take part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.06
MIN_CHARS = 32
BLOCK_BYTES = 1 << 20

HITS = "known boolean, doc_id bigint, check bigint, item_id bigint, edits int, `begin` int, `end` int"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(chars: int, error_rate: float, min_chars: int) -> int:
    return int(chars * error_rate) if chars >= min_chars else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, each with its place in the item."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str) -> tuple[int, int]:
    """Fewest edits from ``item`` to any part of ``text``, and the first end of such a part."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        places[c] |= 1 << i
    more, less, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        here = places.get(c, 0)
        x = here | less
        d = (((here & more) + more) ^ more) | here
        up = less | (~(d | more) & full)
        down = more & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        up = (up << 1) & full
        down = (down << 1) & full
        more = down | (~(x | up) & full)
        less = up & x
    return best, end


class Finder:
    """Searches texts for the items of one block."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_chars: int):
        import ahocorasick

        by_text: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if clean := normal(text):
                by_text[clean].append(item_id)
        self.texts = list(by_text)
        self.ids = [sorted(by_text[t]) for t in self.texts]
        self.edits = [budget(len(t), error_rate, min_chars) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (text, edits) in enumerate(zip(self.texts, self.edits, strict=True)):
            for place, piece in pieces(text, edits):
                found[piece].append((n, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def search(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """``item_id, edits, begin, end`` of the best match of each item in the normal text."""
        clean = normal(text)
        if not clean or not self.any:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, where) in self.automaton.iter(clean):
            for n, place in where:
                starts[n].add(last - length + 1 - place)
        for n, at in sorted(starts.items()):
            item, edits = self.texts[n], self.edits[n]
            windows: list[list[int]] = []
            for s in sorted(at):
                low, high = max(s - edits, 0), min(s + len(item) + edits, len(clean))
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(high, windows[-1][1])
                else:
                    windows.append([low, high])
            best = None
            for low, high in windows:
                distance, end = best_match(item, clean[low:high])
                if distance <= edits and (best is None or distance < best[0]):
                    best = distance, low + end
                    if not distance:
                        break
            if best:
                part = clean[max(best[1] - len(item) - best[0], 0) : best[1]]
                back = best_match(item[::-1], part[::-1])[1]
                for item_id in self.ids[n]:
                    yield item_id, best[0], best[1] - back, best[1]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, edits, begin, end``.

    ``begin`` and ``end`` count characters of the document's normal text.
    """
    found = _hits(docs, benchmark, doc_id, text, item_id, item_text, error_rate, min_chars, block_bytes)
    return found.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "item_id", "edits", "begin", "end")


def _hits(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str,
    text: str,
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    rows = docs.select(*_row_key(doc_id, text), F.col(text).alias("text"))

    def search(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value, error_rate, min_chars)
            for batch in batches:
                found = [
                    (known, d, check, *hit)
                    for known, d, check, t in zip(batch["known"], batch["doc_id"], batch["check"], batch["text"], strict=True)
                    for hit in finder.search(t)
                ]
                out = pd.DataFrame(found, columns=["known", "doc_id", "check", "item_id", "edits", "begin", "end"])
                yield out.astype({"item_id": "Int64"})

        return rows.mapInPandas(scan, HITS)

    found = spark.createDataFrame([], HITS)
    for block in range(blocks):
        found = search(block) if block == 0 else found.unionByName(search(block))
    return found


def _row_key(doc_id: str, text: str) -> list[Column]:
    """Id and text hash, which tell rows apart; a null id is marked, as Python would turn ids beside nulls into fractions."""
    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(0).cast("bigint"))
    return [F.col(doc_id).isNotNull().alias("known"), number.alias("doc_id"), F.xxhash64(text).alias("check")]


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows in whose text no item was found; rows that share an id are judged each by its own text."""
    leaking = _hits(docs, benchmark, doc_id, text, **options).select("known", "doc_id", "check").distinct()
    names = ["__known", "__doc", "__check"]
    keyed = docs.withColumns(dict(zip(names, _row_key(doc_id, text), strict=True)))
    return keyed.join(leaking.toDF(*names), names, "left_anti").drop(*names)
