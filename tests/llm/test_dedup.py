"""Near duplicates, repeated bytes and the pipeline, against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, jaccard, suffix_dedup, suffixes
from millrace.llm.shingles import shingle_set

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts_for_join():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 7)))
    base = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    for _ in range(60):  # a crowd whose members are near some others only
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    texts += [None, "", " \n", "A b", "a B", "a  b", "one", texts[3], texts[3].upper(), texts[50] + "\t"]
    return texts


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
        if all(group[i] == group[group[i]] for i in range(len(ids))):
            break
    low = {}
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, len(s), low.get(g)) for i, s, g in zip(ids, sets, group, strict=True)]


@pytest.mark.parametrize("small", [12, 2])
def test_join_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    texts = texts_for_join()
    ids = [*range(len(texts) - 1), None]
    rows = [(i, t, "n", "x") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cls string, n string")
    got = [tuple(r) for r in jaccard.near_duplicates(df).collect()]
    expected = brute_components(ids, texts)
    assert Counter(got) == Counter(expected)


def template_rows(n, shared, own):
    """Documents of one template: ``shared`` words of all, then ``own`` words of each."""
    head = " ".join(f"t{i}" for i in range(shared))
    return [(d, head + " " + " ".join(f"d{d}w{i}" for i in range(own))) for d in range(n)]


@pytest.mark.parametrize("shared,own", [(204, 42), (204, 38), (204, 60)])
def test_documents_of_a_template_do_not_meet(spark, shared, own):
    """Shingles: 200 of all and 4 + own of each, so the similarity is below 75 % but near it; nothing grows as the square."""
    similarity = 100 * 200 / (200 + 2 * (own + 4))
    assert 60 < similarity < 75
    met = []
    for n in (150, 300):
        df = spark.createDataFrame(template_rows(n, shared, own), "doc_id bigint, text string")
        found = jaccard.features(df, "doc_id", "text", 75)
        regions = jaccard.regions_of(found.select("cls", "pivots", "indexed"))
        met.append((regions.count(), jaccard._pairs_of_small(regions).count()))
        if n == 150:
            got = jaccard.near_duplicates(df).collect()
            assert all(r.component_id == r.doc_id for r in got)
    assert met[1][0] <= 2.2 * met[0][0] + 50 and met[1][1] <= 2.2 * met[0][1] + 50


def near_copies(n, seed=11, most=4):
    """Texts of one base with up to ``most`` words changed in each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, most + 1)):
            copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    return texts


def test_pairs_of_near_copies_do_not_grow_as_the_square(spark, monkeypatch):
    """Each of a crowd of near copies is measured against few others, though most of all pairs are links."""
    from millrace.scratch import persist_table

    measured, real = [], jaccard.measure_pairs

    def counted(pairs, texts):
        pairs = persist_table(pairs, "counted")
        measured[-1] += pairs.count()
        return real(pairs, texts)

    monkeypatch.setattr(jaccard, "measure_pairs", counted)
    for n in (250, 500):
        measured.append(0)
        df = spark.createDataFrame(list(enumerate(near_copies(n, most=5))), "doc_id bigint, text string")
        assert jaccard.near_duplicates(df).count() == n
    assert measured[1] <= 3.5 * measured[0] and measured[1] <= 10 * 500


def test_near_copies_in_small_blocks(spark, monkeypatch):
    """Crowds whose members meet in many blocks and parts, against brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "GUESTS", 4)
    texts = near_copies(70) + near_copies(40, 12) + texts_for_join()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = brute_components(list(range(len(texts))), texts)
    assert Counter(map(tuple, jaccard.near_duplicates(df).collect())) == Counter(expected)


def test_first_shared_shingle_is_near_both():
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for _ in range(3000):
        union = np.unique(rng.integers(0, 2**62, rng.integers(1, 60)).astype(np.uint64))
        role = rng.choice([0, 1, 2], len(union), p=[0.8, 0.1, 0.1])
        a, b = union[role != 1], union[role != 2]
        if not len(a) or not len(b) or 100 * (role == 0).sum() < 75 * len(union):
            continue
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        first = np.intersect1d(a, b)[0]
        near, home = jaccard.pivots_of(small, none, none, 75)
        assert first in near[:home] and first in jaccard.pivots_of(large, none, none, 75)[0]


def test_join_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(1, 0, 1), (1, 0, 1), (2, 0, 2)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(100):
        pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 1500))) for _ in range(2))
        x, y = jaccard.sketch_of(a), jaccard.sketch_of(b)
        size = min(len(x), len(y))
        least = int(jaccard._differing(jaccard.fold(x, size), jaccard.fold(y, size)))
        assert least <= len(np.setxor1d(a, b))


def test_long_texts_are_cut_between_words(monkeypatch):
    from millrace.llm import shingles

    text = " ".join(f"w{i * 7919 % 1000}" for i in range(4000)) + " " + "x" * 900 + " end of it"
    whole = shingle_set(text)
    monkeypatch.setattr(shingles, "SEGMENT", 256)
    assert (shingle_set(text) == whole).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    group = {n: n for p in links for n in p}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {n: group[n] for n in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- repeated bytes ------------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.HOT, 1, 2, 5, 12])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    """``most`` decides from which group size on marks are split by content."""
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 20)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 30)
    rng = random.Random(6)
    said = lambda n: "".join(rng.choices("abcdeé ", k=n))
    passages = [said(n) for n in (120, 199, 200, 201, 260, 700)]
    texts = [None, "", "x" * 199, "y" * 200, "z" * 450, "ab" * 300, said(5000)]
    for _ in range(40):
        texts.append("".join(rng.choice([said(rng.randrange(300)), rng.choice(passages)]) for _ in range(4)))
    texts += [texts[10], texts[11], texts[11][30:], texts[12][:-17]]
    ids = [*range(len(texts) - 3), None, None, 4]
    rows = [(i, t, "own") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_spans string")
    got = suffix_dedup.remove_repeats(df, most=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = [(i, *r) for i, r in zip(ids, brute_repeats(texts, 200), strict=True)]
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_no_merge_gets_a_hot_mark(spark):
    """One passage in all documents, inside unlike texts, exactly copied texts besides."""
    rng = random.Random(8)
    said = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, copy = said(230), said(900)
    texts = [said(250) + passage + said(250) for _ in range(60)] + [copy] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keyed = suffix_dedup._keyed(df, "doc_id", "text")
    left, known = suffix_dedup.unlike_suffixes(keyed, "text", 200, 10)
    assert len(left) > 1
    for rows in left:
        sizes = rows.groupBy("mark").count().agg(F.max("count")).first()[0]
        assert sizes is None or sizes <= 10
    assert sum(k.count() for k in known) > 60
    got = suffix_dedup.remove_repeats(df, most=10).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = [(i, *r) for i, r in enumerate(brute_repeats(texts, 200))]
    assert sorted(map(tuple, got.collect())) == expected


def test_suffixes_of_one_passage_travel_in_many_rows(spark, monkeypatch):
    """One passage in all documents: no row of ``local`` holds more than a few parts' share of its suffixes."""
    held, real = [], suffix_dedup.persist_table

    def watched(rows, label):
        table = real(rows, label)
        if label == "local":
            held.append(table.agg(F.max(F.size("members")), F.sum(F.size("members"))).first())
        return table

    monkeypatch.setattr(suffix_dedup, "persist_table", watched)
    rng = random.Random(8)
    said = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = said(700)
    texts = [said(300) + passage + said(300) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == [(i, *r) for i, r in enumerate(brute_repeats(texts, 200))]
    largest, every = held[0]
    assert every >= 600 and largest <= 3 * 32


def test_merge_of_front_coded_runs():
    rng = random.Random(9)
    for _ in range(200):
        runs = []
        for _ in range(rng.randrange(1, 9)):
            texts = sorted(bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) for _ in range(rng.randrange(0, 12)))
            runs.append(suffixes.front_decode(*suffixes.front_code(texts)))
            assert runs[-1].texts == texts
        out = suffixes.merge(runs)
        merged = [runs[r].texts[i] for r, i, _ in out]
        assert merged == sorted(t for r in runs for t in r.texts)
        for k, (_, _, shared) in enumerate(out[1:], 1):
            assert shared == suffixes.common_prefix(merged[k - 1], merged[k], 0)


def test_equal_windows_choose_alike(monkeypatch):
    rng = random.Random(2)
    for segment in (1 << 18, 500):
        monkeypatch.setattr(suffixes, "SEGMENT", segment)
        data = bytes(rng.choices(b"abc", k=3000))
        chosen = {}
        for _, place, first, last, _ in zip(*suffixes.marked_suffixes(data + data, 200), strict=True):
            for i in range(first, last + 1):
                assert chosen.setdefault(int(i), int(place - i)) == place - i
        assert sorted(chosen) == list(range(len(data) * 2 - 199))
        assert all(chosen[i] == chosen[i + 3000] for i in range(2801))


# -- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    from millrace.scratch import persist_table
    from millrace.tables import load

    docs = load(spark, sf_dir, "documents").withColumn("n_removed", F.lit("own"))
    odd = spark.createDataFrame([(None, None, None, None, None, "own"), (10**6, "", "en", "s", 0, "own")], docs.schema)
    docs = docs.unionByName(odd)
    bench = [r.text for r in load(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, persist_table(stage(spark, docs, sf_dir), name)
        if name != "mixing":
            assert docs.columns == before.columns
            assert docs.count() <= before.count()
        if name == "suffix_dedup":
            texts = [r.text for r in before.select("text").collect()]
            assert docs.count() == len(texts)
            left = {r.doc_id: r.text for r in docs.collect()}
            gone = [r[1] for r in brute_repeats(texts, 200)]
            ids = [r.doc_id for r in before.select("doc_id").collect()]
            for i, t, n in zip(ids, texts, gone, strict=True):
                if not n:
                    assert left[i] == t
    final = docs.collect()
    assert final and {r.n_removed for r in final} == {"own"}
    assert not any(b in (r.text or "") for b in bench for r in final)
    assert {r.copy for r in final} <= {1, 2, 3}


def test_pipeline_of_nothing(spark, sf_dir):
    from millrace.tables import load

    docs = load(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[2:]:
        assert stage(spark, docs, sf_dir).count() == 0


def said_words(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(60))


def test_repeated_rows_leave_one(spark):
    """A repeated row, null-id copies and a null id alone: one of each stays, with its whole text."""
    from millrace.scratch import persist_table

    a, b, c, d = (said_words(s) for s in range(4))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (3, None), (3, None), (None, "")]
    df = spark.createDataFrame([(*r, "en", "s", 400) for r in rows], SCHEMA)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left == Counter([(1, a), (2, b), (None, c), (3, d), (3, None), (3, None), (None, "")])
    unlike = persist_table(corpus_pipeline.near_duplicates(spark, df, ""), "near")
    out = corpus_pipeline.repeated_passages(spark, unlike, "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == left


def test_texts_with_equal_short_hashes_are_told_apart(spark):
    """Two texts of one id whose 32-bit hashes agree: only the one that repeats elsewhere loses bytes."""
    text = F.concat(F.lpad(F.col("id").cast("string"), 12, "0"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")), 256) for k in range(5)])
    many = spark.range(400_000).select(F.col("id"), F.hash(text).alias("h"))
    twins = many.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").first()
    a, b = (spark.range(n, n + 1).select(text.alias("t")).first().t for n in (twins.a, twins.b))
    df = spark.createDataFrame([(5, a), (5, b), (6, a + "tail")], "doc_id bigint, text string")
    got = {(r.doc_id, r.text): r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[5, b] == 0 and got[5, a] > 0 and got[6, a + "tail"] > 0


def test_equal_ids_with_unlike_texts(spark):
    """Rows of one id with unlike texts, against brute force; only the copies of a removed one go."""
    texts = texts_for_join()
    ids = [i % 7 if i < 110 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "n", "x") for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, cls string, n string")
    expected = brute_components(ids, texts)
    assert Counter(map(tuple, jaccard.near_duplicates(df).collect())) == Counter(expected)
    a, b, c = (said_words(s) for s in range(3))
    df = spark.createDataFrame([(5, a), (4, a), (5, b), (5, c), (6, c)], "doc_id bigint, text string")
    left = sorted(map(tuple, jaccard.one_of_each(df).collect()))
    assert left == sorted([(4, a), (5, b), (5, c)])
