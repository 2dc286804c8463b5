"""What one task holds, and how often rows move, stays the same when tables grow."""

from __future__ import annotations

import os
import random

import pandas as pd
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from millrace.operators import learning, mutations, nested, profile
from millrace.sources import trees


def test_documents_are_dealt_before_their_pairs_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(nested, "DOCUMENTS_A_TASK", 10)
    parts, scan = [], nested._scan
    monkeypatch.setattr(nested, "_scan", lambda df, *a: parts.append(df.rdd.getNumPartitions()) or scan(df, *a))
    df = spark.range(100).coalesce(1).select((F.col("id") % 60).alias("id"), F.lit('[{"a": "1"}, {"a": "2", "b": {"c": "x"}}]').alias("doc"))
    rows = nested.flatten_to_pairs(df, "id", "doc", "P").collect()
    assert sorted((r.id, r.name, r.value) for r in rows) == sorted(x for i in range(60) for x in ((i, "P_A", "2"), (i, "P_LAYER_C", "x")))
    assert parts == [10]


def test_folders_with_little_in_them_share_a_batch(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "x").write_text("12")
    found, kind = [], type(spark.range(0))
    run = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda df, func, *a, **k: found.append(func) or run(df, func, *a, **k))
    assert trees.list_files(spark, str(tmp_path)).count() == 30
    batches = list(found[-1](iter([pd.DataFrame({"name": [f"f{i}" for i in range(30)]})])))
    assert len(batches) == 1 and len(batches[0]) == 30


def test_one_file_of_many_rows_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    seen, join = [], trees._join_pieces

    def spy(pieces, root):
        seen.extend(r.name for r in pieces.collect())
        return join(pieces, root)

    monkeypatch.setattr(trees, "_join_pieces", spy)
    name = F.when(F.col("id") % 50 == 0, F.concat(F.lit("d/small"), "id")).otherwise("d/large")
    df = spark.range(3000).select("id", name.alias("n"))
    assert trees.write_files(df, str(tmp_path), F.col("n"), F.concat(F.col("id").cast("string"), F.lit("é\n")), ["id"]) == 61
    assert seen.count("d/large") > 5
    assert (tmp_path / "d/large").read_text().split("é\n") == [*(str(i) for i in range(3000) if i % 50), ""]
    assert sorted(os.listdir(tmp_path / "d")) == sorted(["large", *(f"small{i}" for i in range(0, 3000, 50))])


def test_pieces_follow_each_other_where_a_file_has_one_writer(tmp_path):
    system = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    for piece, text in (("a1", "one "), ("a2", "two "), ("a3", "three"), ("b1", ""), ("b2", "four")):
        (tmp_path / piece).write_text(text)
    trees._append(system, iter([("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("b1", "b1"), ("b2", "b1")]))
    assert (tmp_path / "a1-whole").read_text() == "one two three"
    assert (tmp_path / "b1-whole").read_text() == "four"


def test_exact_profiles_group_rows_in_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.range(200).coalesce(1).select((F.col("id") % 7).alias("a"), F.when(F.col("id") > 3, F.col("id")).alias("b"))
    whole = profile.profile_columns(df, exact=True).collect()
    monkeypatch.setattr(profile, "DISTINCT_ROWS", 20)
    dealt = profile.profile_columns(df, exact=True)
    assert "__dealt" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole))
    assert {r.column_name: (r.num_distincts, r.num_nulls) for r in whole} == {"a": (7, 0), "b": (196, 4)}


@pytest.mark.parametrize("values", [[3.5], [1.0, 1.0, 1.0, 9.0], [None, 5.0, -2.0, 5.0, 0.25, None, 1e9], [float(i * i % 97) for i in range(301)], [None]])
def test_exact_quantiles_are_those_of_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = [0.0, 0.1, 0.45, 0.5, 0.55, 1.0]
    assert profile.exact_quantiles(df, "x", shares) == df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]


def test_requests_of_keys_in_one_group_do_not_go_up(spark, monkeypatch):
    monkeypatch.setattr(mutations, "TURNS", 16)
    sizes, before = [], mutations._states_before
    monkeypatch.setattr(mutations, "_states_before", lambda turns, *a: sizes.append(turns.count()) or before(turns, *a))
    rng = random.Random(3)
    rows = [(f"k{i % 200:03}", i, rng.choice(["stop", "rm", "snapshot"]), None) for i in range(400)]
    rows += [("z", i, "snapshot", "n") for i in range(600)] + [("k000", 0, rows[0][2], None)] * 2  # equal ones too
    requests = spark.createDataFrame(rows, "uuid string, at int, action string, note string")
    states = spark.createDataFrame([(f"k{i:03}", "running") for i in range(200)], "uuid string, status string")
    done = mutations.transitions_in_turn(requests, states, "uuid", ["at"]).collect()
    assert sorted((r.uuid, r.at, r.action, r.note or "") for r in done) == sorted((*r[:3], r[3] or "") for r in rows)
    assert sizes[0] == 1002 and sizes[1] <= 2 * (1002 // 16 + 1)


def test_a_pair_meets_its_factors_without_its_numbers(spark):
    known = spark.createDataFrame([(u, f"i{i}", float(u * i)) for u in range(1, 6) for i in range(1, 5)], "user int, item string, rating double")
    factors = learning.train_als(known, rank=2, max_iter=3, blocks=2)
    asked = known.select("user", "item").unionByName(spark.createDataFrame([(1, "i1"), (9, "i1"), (None, "i2")], "user int, item string"))
    found = learning.predict_pairs(factors, asked)
    assert "UDF" not in found._jdf.queryExecution().toString()
    numbered = learning._numbered(asked, factors.users, factors.items)
    wanted = factors.model.transform(numbered).select("user", "item", F.col("prediction").cast("double"))
    got, want = (sorted(map(tuple, df.collect())) for df in (found, wanted))
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 21
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-6)
