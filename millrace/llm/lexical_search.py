"""Ranked lexical search with per-term geometric blocking: exact best documents for a set of queries.

The index has all documents with a term, packed into shards of about ``SHARD_POSTINGS`` postings: their
terms, how often each occurs, and their lengths.  A document scores the sum over a
query's terms of weight times impact, all in whole numbers:

    weight = floor(1000 ln((2 N + 2) / (2 df + 1)))     impact = 10^9 tf div (1000 tf + 8 m)
    m = 10 + 90 n N div L                               (N documents, L terms, n terms in this one)

Queries are dealt into groups of about ``GROUP_TERMS`` terms; a group meets a bundle of shards in one
task, a shard at a time.  There each posting list is
clustered by the similarity of its documents (nearest of some of them, by a random projection
of the impacts), the clusters are cut into blocks, and a block keeps the coordinatewise maximum of
its documents' impacts.  A query goes through its lists from the one that can give most; it
stops when the lists left cannot reach the ``k``-th best score, and looks into a block only if the bound
by its maxima does.  The bound is never too low, so results are exact.  The first bundles
give each query a score that its ``k`` best documents reach at least; the others start from it.

Cases: null texts and texts without a term are neither found nor counted; a query without terms finds
nothing; long texts are indexed whole; repeated documents and queries are ranked each by
itself, equal scores by ascending document id (nulls first); fewer than ``k`` documents above
score 0 give fewer rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import persist_table

SHARD_POSTINGS = 400_000
GROUP_TERMS = 4096
BUNDLE = 4  # shards that meet a group of queries in one task, one after the other
FIRST_SHARE = 8  # one bundle in so many is searched first
BLOCK = 32  # documents of a block
CELLS = 1 << 25  # impacts that a task holds at a time, documents times terms
SKETCH = 8

# ASCII other than letters and digits separates terms, A to Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text as UTF-8; every character beyond ASCII belongs to a term, so bytes suffice."""
    return text.encode("utf-8", "replace").translate(_TERM_BYTES).split()


class Index(NamedTuple):
    shards: DataFrame
    """A row for some documents: ``shard`` (its number), ``known``, ``ids``, ``lengths``, ``sizes`` and ``postings``, packed."""
    documents: int
    length: int
    count: int
    """Of shards."""


def _ints(*arrays: list | np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.asarray(a, np.int32).tobytes() for a in arrays), 1)


def _packed(known: list, ids: list, counters: list[Counter]) -> dict:
    vocabulary: dict[bytes, int] = {}
    places = [vocabulary.setdefault(t, len(vocabulary)) for c in counters for t in c]
    return {
        "known": known,
        "ids": ids,
        "lengths": [c.total() for c in counters],
        "sizes": list(map(len, counters)),
        "terms": zlib.compress(b"\n".join(vocabulary), 1),
        "places": _ints(places),
        "times": _ints([n for c in counters for n in c.values()]),
    }


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int32)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index every document that holds a term."""
    kind = docs.schema[doc_id].dataType

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ids, counters, held = [], [], [], 0
        for batch in batches:
            for sure, i, t in zip(batch["known"].tolist(), batch["id"].tolist(), batch["text"], strict=True):
                counter = Counter(terms_of(t))
                if not counter:
                    continue
                known.append(sure)
                ids.append(i)
                counters.append(counter)
                held += len(counter)
                if held >= SHARD_POSTINGS:
                    yield pd.DataFrame([_packed(known, ids, counters)])
                    known, ids, counters, held = [], [], [], 0
        if counters:
            yield pd.DataFrame([_packed(known, ids, counters)])

    # The id travels with a mark for null, as Python would turn numbers beside nulls into fractions.
    rows = docs.select(
        F.col(doc_id).isNotNull().alias("known"),
        F.coalesce(doc_id, F.lit("0").cast(kind)).alias("id"),
        F.col(text).alias("text"),
    ).filter(F.octet_length("text") > 0)
    fields = f"known array<boolean>, ids array<{kind.simpleString()}>, lengths array<bigint>, sizes array<int>"
    packed = rows.mapInPandas(pack, fields + ", terms binary, places binary, times binary")
    shards = persist_table(packed.select(F.monotonically_increasing_id().alias("shard"), "*"), "lexical-index")
    length = F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, n: s + n))
    total = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(length, F.lit(0)), F.count(F.lit(1)))
    return Index(shards, *map(int, total.first()))


def document_counts(index: Index) -> DataFrame:
    """How many documents hold each term, added up in each shard first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for terms, places in zip(batch["terms"], batch["places"], strict=True):
                names = [t.decode() for t in zlib.decompress(terms).split(b"\n")]
                yield pd.DataFrame({"term": names, "df": np.bincount(_numbers(places), minlength=len(names))})

    counted = index.shards.select("terms", "places").mapInPandas(count, "term string, df bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(text: Column) -> Column:
    """The distinct terms of a query."""

    @F.pandas_udf("array<string>")
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[t.decode() for t in dict.fromkeys(terms_of(x))] if x else [] for x in texts])

    return distinct(text)


def weight(documents: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * documents + 2) / (2 * df + 1))).cast("bigint")


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + (90 * lengths * documents) // length
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class Blocks(NamedTuple):
    docs: np.ndarray
    """The documents of a posting list, block after block."""
    starts: np.ndarray
    maxima: np.ndarray
    """A row for each block: the greatest impact of each of the ``near`` terms among its documents."""
    near: np.ndarray


class Shard:
    """Posting lists of some documents, over the terms that a group of queries uses.

    ``near`` has for each term the terms (in order) that stand in a query with it: no other is asked of its blocks.
    """

    def __init__(
        self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int, weights: np.ndarray, near: list[np.ndarray]
    ):
        self.impact = np.zeros((size, len(weights)), np.int32)
        self.impact[docs, terms] = values
        order = np.argsort(terms, kind="stable")
        self._docs = docs[order]
        self._bounds = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.most = self.impact.max(0, initial=0).astype(np.int64)
        self._weights, self._near = weights, near
        self._blocks: dict[int, Blocks] = {}
        self._sketch: np.ndarray | None = None

    def _similar(self) -> np.ndarray:
        if self._sketch is None:
            directions = np.random.default_rng(12).standard_normal((len(self._weights), SKETCH), np.float32)
            sketch = self.impact.astype(np.float32) @ (directions * self._weights[:, None].astype(np.float32))
            self._sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        return self._sketch

    def blocks(self, term: int) -> Blocks:
        if term not in self._blocks:
            docs = self._docs[self._bounds[term] : self._bounds[term + 1]]
            if len(docs) <= BLOCK:
                starts = np.zeros(1, np.int64)
            else:
                sketch = self._similar()
                centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
                nearest = (sketch[docs] @ sketch[centres].T).argmax(1)
                order = np.argsort(nearest, kind="stable")
                docs, nearest = docs[order], nearest[order]
                begins = np.searchsorted(nearest, nearest)  # where the cluster of each document begins
                starts = np.flatnonzero((np.arange(len(docs)) - begins) % BLOCK == 0)
            near = self._near[term]
            maxima = np.maximum.reduceat(self.impact[docs[:, None], near], starts, axis=0)
            self._blocks[term] = Blocks(docs, starts, maxima, near)
        return self._blocks[term]


class Best:
    """The best documents of a query so far, and the score that the next one has to reach."""

    def __init__(self, k: int, bar: int):
        self.k, self.bar = k, max(bar, 1)
        self.found: list[tuple] = []  # (-score, known, id, shard, place)

    def add(self, found: list[tuple]) -> None:
        self.found = sorted(self.found + found)[: self.k]
        if len(self.found) == self.k:
            self.bar = max(self.bar, -self.found[-1][0])


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best, keys: list[tuple]) -> None:
    """Give ``best`` every document of the shard that may belong to it."""
    order = np.argsort(-(weights * shard.most[terms]), kind="stable")
    terms, weights = terms[order], weights[order]
    left = np.cumsum((weights * shard.most[terms])[::-1])[::-1]
    seen = np.zeros(len(shard.impact), bool)
    for i, term in enumerate(terms):
        if left[i] < best.bar:
            return
        blocks = shard.blocks(term)
        bounds = blocks.maxima[:, np.searchsorted(blocks.near, terms)] @ weights
        by_bound = np.argsort(-bounds, kind="stable")
        ends = np.append(blocks.starts[1:], len(blocks.docs))
        at, step = 0, 1
        while at < len(by_bound) and bounds[by_bound[at]] >= best.bar:
            chosen = by_bound[at : at + step]
            chosen = chosen[bounds[chosen] >= best.bar]
            docs = np.concatenate([blocks.docs[blocks.starts[b] : ends[b]] for b in chosen])
            docs = docs[~seen[docs]]
            seen[docs] = True
            scores = shard.impact[docs][:, terms] @ weights
            good = scores >= best.bar
            if good.any():
                best.add([(-int(s), *keys[d]) for d, s in zip(docs[good], scores[good], strict=True)])
            at, step = at + step, step * 2


def terms_near(asked: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each term the terms of all queries that hold it."""
    by_term: list[list[np.ndarray]] = [[] for _ in range(size)]
    for places in asked:
        own = np.sort(places)
        for term in places:
            by_term[term].append(own)
    return [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in by_term]


def _search_group(shards: pd.DataFrame, queries: pd.DataFrame, documents: int, length: int, k: int) -> pd.DataFrame:
    """All queries of a group against some shards, one after the other, and some documents at a time."""
    found = []
    if len(shards) and len(queries):
        vocabulary = {t.encode(): i for i, t in enumerate(dict.fromkeys(chain.from_iterable(queries["terms"])))}
        weights = np.zeros(len(vocabulary), np.int64)
        asked = []
        for terms, own, bar in zip(queries["terms"], queries["weights"], queries["bar"], strict=True):
            places = np.array([vocabulary[t.encode()] for t in terms])
            weights[places] = own
            asked.append((places, np.asarray(own, np.int64), Best(k, int(bar))))
        near = terms_near([places for places, _, _ in asked], len(vocabulary))
        step = max(CELLS // max(len(vocabulary), 1), 1)
        for row in shards.sort_values("shard").itertuples():
            names = zlib.decompress(row.terms).split(b"\n")
            here = np.array([vocabulary.get(t, -1) for t in names])
            sizes, lengths = np.asarray(row.sizes, np.int64), np.asarray(row.lengths, np.int64)
            places = here[_numbers(row.places)]
            owners = np.repeat(np.arange(len(sizes)), sizes)
            values = impacts(_numbers(row.times).astype(np.int64), lengths[owners], documents, length)
            known, ids = list(row.known), list(row.ids)
            keys = [(bool(a), b, row.shard, i) for i, (a, b) in enumerate(zip(known, ids, strict=True))]
            for low in range(0, len(sizes), step):
                held = (places >= 0) & (owners >= low) & (owners < low + step)
                size = min(step, len(sizes) - low)
                shard = Shard(owners[held] - low, places[held], values[held], size, weights, near)
                for own_places, own, best in asked:
                    search_shard(shard, own_places, own, best, keys[low : low + step])
        for query, (_, _, best) in zip(queries["query"], asked, strict=True):
            found += [(query, known, key, shard, place, -score) for score, known, key, shard, place in best.found]
    return pd.DataFrame(found, columns=["query", "known", "id", "shard", "place", "score"])


def search(
    index: Index, queries: DataFrame, item_id: str = "item_id", text: str = "text", doc_id: str = "doc_id", k: int = 10
) -> DataFrame:
    """The ``k`` best documents of each query: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = queries.sparkSession
    kind = index.shards.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).alias("item"), F.col(text).alias("text"))
    asked = persist_table(asked.select("query", "item", query_terms(F.col("text")).alias("terms")), "queries")
    counts = document_counts(index).withColumn("weight", weight(index.documents, F.col("df")))
    each = asked.select("query", F.explode("terms").alias("term")).join(counts.filter("weight > 0"), "term")
    weighed = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("w"))
    total = persist_table(weighed.select("query", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights")), "weighed")
    groups = int(total.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // GROUP_TERMS + 1
    bundles = index.count // BUNDLE + 1
    first = -(-bundles // FIRST_SHARE)

    def dealt(low: int, high: int, bars: DataFrame) -> DataFrame:
        """Each group of queries against each bundle of shards from ``low`` to ``high``."""
        shards = index.shards.withColumn("bundle", F.pmod(F.xxhash64("shard"), F.lit(bundles)))
        shards = shards.filter(F.col("bundle").between(low, high - 1))
        shards = shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        sent = total.join(bars, "query", "left").select(
            F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))).alias("bundle"),
            F.pmod(F.hash("query"), F.lit(groups)).alias("group"),
            "query", "terms", "weights", F.coalesce("bar", F.lit(0).cast("bigint")).alias("bar"),
        )
        run = partial(_search_group, documents=index.documents, length=index.length, k=k)
        # A fixed number of partitions: adaptive execution would merge the work by its bytes.
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), (high - low) * groups)
        both = shards.repartition(tasks, "bundle", "group").groupBy("bundle", "group").cogroup(sent.groupBy("bundle", "group"))
        return both.applyInPandas(
            lambda shards, queries: run(shards, queries),
            f"query bigint, known boolean, id {kind}, shard bigint, place bigint, score bigint",
        )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "known", "id", "shard", "place")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    nobody = spark.createDataFrame([], "query bigint, bar bigint")
    found = persist_table(dealt(0, first, nobody), "found")
    if first < bundles:
        bars = ranked(found).filter(F.col("rank") == k).select("query", F.col("score").alias("bar"))
        found = found.unionByName(dealt(first, bundles, bars))
    return ranked(found).join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item_id), "rank", F.when(F.col("known"), F.col("id")).alias(doc_id), "score"
    )
