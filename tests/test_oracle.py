"""Every registered query against its reference SQL; the others by invariants."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from millrace import tables
from tests.oracle import compare, type_differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(key, spark, sf_dir, duck):
    df = QUERIES[key](spark, sf_dir)
    assert type_differences(df, duck, ORACLES[key]) == {}
    _rows, problem = compare(df, duck, ORACLES[key])
    assert problem is None, problem


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(tables.SCHEMAS))
def test_declared_schema_is_the_file_schema(name, spark, sf_dir):
    written = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    declared = tables.load(spark, sf_dir, name).schema
    assert [(f.name, f.dataType) for f in declared] == [(f.name, f.dataType) for f in written]


def test_approximate_profile_is_close_to_the_exact_one(spark, sf_dir):
    exact = {r.column_name: r for r in tables_profile(spark, sf_dir, True)}
    close = {r.column_name: r for r in tables_profile(spark, sf_dir, False)}
    for name, row in exact.items():
        assert abs(close[name].num_distincts - row.num_distincts) <= 0.15 * row.num_distincts + 2
        assert close[name].num_nulls == row.num_nulls and close[name].max_length == row.max_length


def tables_profile(spark, sf_dir, exact):
    from millrace.operators.profile import profile_columns

    return profile_columns(tables.load(spark, sf_dir, "customer"), exact=exact).collect()


def test_kmeans_query_places_every_vector(spark, sf_dir):
    placed = QUERIES["train_kmeans"](spark, sf_dir).collect()
    assert [r.cluster for r in sorted(placed)] == [0, 1]
    assert sum(r.points for r in placed) == tables.load(spark, sf_dir, "embeddings").count()


def test_logistic_query_beats_the_majority(spark, sf_dir):
    counts = {(r.label, r.prediction): r.cnt for r in QUERIES["train_logistic"](spark, sf_dir).collect()}
    total = sum(counts.values())
    right = sum(n for (label, guess), n in counts.items() if label == guess)
    by_label = {x: sum(n for (label, _), n in counts.items() if label == x) for x in (0.0, 1.0)}
    assert right >= 0.9 * max(by_label.values())
    error = QUERIES["logistic_training_error"](spark, sf_dir).first().error
    assert error == pytest.approx(1 - right / total)


def test_als_query_beats_the_global_mean(spark, sf_dir):
    from millrace.plans.join_plans import ratings
    from millrace.plans.registry import Tables

    known = ratings(Tables(spark, sf_dir))
    variance = known.selectExpr("var_pop(rating)").first()[0]
    assert QUERIES["train_als"](spark, sf_dir).first().mse < variance
    assert QUERIES["predict_pairs"](spark, sf_dir).count() == known.count()
