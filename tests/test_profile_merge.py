"""Statistics that are stored and added up, and heavy hitters from bounded counters."""

from __future__ import annotations

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import profile

SCHEMA = "part string, n int, big bigint, x double, s string, b boolean, d decimal(10,2), t timestamp_ntz, empty string"


def rows_of(seed, n, parts):
    rng = random.Random(seed)
    none = lambda v: None if rng.random() < 0.1 else v
    return [
        (rng.choice(parts), none(rng.randrange(500)), none(rng.randrange(2**60)), none(rng.gauss(0, 9)), none("é" * rng.randrange(30)),
         none(rng.random() < 0.3), none(Decimal(rng.randrange(10**6)) / 100), none(datetime.datetime(2024, 1, rng.randrange(1, 28))), None)
        for _ in range(n)
    ]


def test_merged_statistics_are_those_of_all_rows(spark):
    old, new = rows_of(1, 900, ["a", "b", None]), rows_of(2, 700, ["b", "c"])
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    stored = profile.partition_statistics(frame(old), ["part"])
    both = stored.unionByName(profile.partition_statistics(frame(new), ["part"]))
    for by in ([], ["part"]):
        merged = profile.read_statistics(profile.merge_statistics(both, by), [0.1, 0.9])
        exact = profile.profile_columns(frame(old + new) if by else frame(old + new).drop("part"), by, exact=True)
        got = {tuple(r[c] for c in (*by, "column_name")): r for r in merged.collect()}
        want = {tuple(r[c] for c in (*by, "column_name")): r for r in exact.collect()}
        assert got.keys() == want.keys()
        for key, w in want.items():
            g = got[key]
            for c in ("long_low", "long_high", "double_low", "double_high", "num_nulls", "max_length", "num_trues", "num_falses"):
                assert g[c] == w[c], (key, c)
            assert g.avg_length == pytest.approx(w.avg_length) if w.avg_length is not None else g.avg_length is None
            assert w.decimal_low is None or Decimal(g.decimal_low) == Decimal(w.decimal_low)
            assert abs(g.num_distincts - w.num_distincts) <= 0.05 * w.num_distincts + 1
    whole = {r.column_name: r.quantiles for r in profile.read_statistics(profile.merge_statistics(both), [0.1, 0.9]).collect()}
    ns = sorted(r[1] for r in old + new if r[1] is not None)
    assert abs(whole["n"][0] - ns[len(ns) // 10]) < 25 and abs(whole["n"][1] - ns[len(ns) * 9 // 10]) < 25
    assert whole["s"] is None and whole["empty"] is None
    # Adding up in two steps is the same as in one.
    twice = profile.merge_statistics(profile.merge_statistics(both, ["part"]))
    once = {r.column_name: r.num_nulls for r in profile.read_statistics(profile.merge_statistics(both)).collect()}
    assert {r.column_name: r.num_nulls for r in profile.read_statistics(twice).collect()} == once


@pytest.mark.parametrize("share", [0.5, 0.1, 0.02, 0.004])
def test_heavy_hitters_are_exact(spark, share):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", f"c{int(rng.expovariate(0.1))}", f"d{rng.randrange(5000)}"]), rng.randrange(2)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    counts = Counter(rows)
    got = {(r.k, r.v): r.cnt for r in profile.skewed_values(df, ["k", "v"], share).collect()}
    assert got == {k: n for k, n in counts.items() if n > share * len(rows)}
    candidates, total = profile.heavy_candidates(df, ["k", "v"], share)
    assert total == 6000 and candidates.count() <= 2 / share
    assert profile.skewed_values(df.limit(0), ["k"], share).count() == 0


def test_shares_are_checked(spark):
    with pytest.raises(ValueError, match="share"):
        profile.skewed_values(spark.range(3), ["id"], 0)
    one = spark.createDataFrame([(1.0,), (-0.0,), (0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert profile.skewed_values(one, ["x"], 0.3).count() == 2
    assert one.filter(F.col("x") == 1).count() == 1
