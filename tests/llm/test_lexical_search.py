"""Lexical search against brute force, with blocks, shards and groups cut small, and odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical_search

DOCS = "doc_id bigint, text string, n long, row string, id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    topics = [[f"w{t}x{i}" for i in range(40)] for t in range(6)]
    common = [f"the{i}" for i in range(12)] + ["Été", "ÉTÉ", "日本", "a_b-c", "X1"]
    docs = []
    for d in range(n):
        words = rng.choices(topics[d % 6], k=rng.randrange(1, 40)) + rng.choices(common, k=rng.randrange(0, 40))
        rng.shuffle(words)
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(None, docs[3][1]), (None, docs[5][1]), (7, docs[7][1]), (7, docs[8][1]), (9000, None), (9001, ""), (9002, "?! -")]
    docs += [(10_000 + i, docs[4][1]) for i in range(n // 2)]  # copies of one text
    items = [(i, " ".join(rng.sample(topics[i % 6], 6) + rng.sample(common, 4))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "unheard of"), (0, items[0][1]), (None, docs[4][1]), (24, "the0"), (25, "日本 été")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"SHARD_POSTINGS": 900, "GROUP_TERMS": 60, "BLOCK": 4, "CELLS": 2000, "BUNDLE": 2}])
def test_search_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus(1, 240)
    df = spark.createDataFrame([(*d, 1, "own", "own") for d in docs], DOCS)
    queries = spark.createDataFrame([(*i, "own") for i in items], "item_id bigint, text string, terms string")
    found = lexical_search.search(lexical_search.build_index(df), queries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and dict(found.dtypes)["rank"] == "int"
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(docs, items, 10)


def test_blocks_bound_their_documents_and_are_alike():
    rng = np.random.default_rng(0)
    size, width = 400, 60
    groups = rng.integers(0, 4, size)
    dense = rng.integers(1, 10**6, (size, width)) * ((rng.random((size, width)) < 0.3) & (np.arange(width) % 4 == groups[:, None]))
    dense[:, 0] = rng.integers(1, 100, size)
    docs, terms_ = np.nonzero(dense)
    weights = rng.integers(1, 5000, width)
    near = lexical_search.terms_near([np.arange(width)], width)
    shard = lexical_search.Shard(docs, terms_, dense[docs, terms_], size, weights, near)
    for term in range(width):
        blocks = shard.blocks(term)
        assert sorted(blocks.docs) == list(np.flatnonzero(dense[:, term]))
        ends = [*blocks.starts[1:], len(blocks.docs)]
        for b, (low, high) in enumerate(zip(blocks.starts, ends, strict=True)):
            assert 0 < high - low <= lexical_search.BLOCK
            assert (blocks.maxima[b] == dense[blocks.docs[low:high]].max(0)).all()
    # The list that all documents share is cut along the groups, so blocks stay away from most coordinates.
    assert (shard.blocks(0).maxima > 0).mean() < 0.6
    # Few documents are looked at: the others lie in blocks that cannot reach the tenth.
    keys = [(True, d, d) for d in range(size)]
    asked, own = np.arange(0, width, 4), weights[np.arange(0, width, 4)]
    best = lexical_search.Best(10, 0)
    lexical_search.search_shard(shard, asked, own, best, keys)
    scores = dense[:, asked].astype(np.int64) @ own
    want = sorted((-int(s), *k) for s, k in zip(scores, keys, strict=True) if s > 0)[:10]
    assert best.found == want


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    docs = spark.createDataFrame([("b", "Some long " + "words " * 200_000), ("a", "some"), (None, "some")], "doc_id string, text string")
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, items.limit(0)).count() == 0
    rows = lexical_search.search(index, items.union(items), k=2).collect()
    assert [r.rank for r in sorted(rows, key=lambda r: r.rank)] == [1, 1, 2, 2]
    assert {r.doc_id for r in rows if r.rank == 1} == {"b"} and {r.doc_id for r in rows if r.rank == 2} == {None}


def test_near_terms():
    asked = [np.array([2, 0]), np.array([1, 2]), np.array([3])]
    assert [list(x) for x in lexical_search.terms_near(asked, 4)] == [[0, 2], [1, 2], [0, 1, 2], [3]]
