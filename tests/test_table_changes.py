"""Changes to partitioned tables: same rows as the whole rewrite, other partitions' files untouched."""

from __future__ import annotations

import os
import random
import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import mutations, table_changes
from millrace.sources import sinks

COLUMNS = "id bigint, v string, p string, q int"


@pytest.fixture
def table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"v{i}", rng.choice(["a", "b'c", "d e", None]), i % 25) for i in range(1000)]
    df = spark.createDataFrame(rows, COLUMNS)
    name, path = f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / "t")
    sinks.write_partitioned(df, name, ["q", "p"], path)
    yield name, path, df
    spark.sql(f"DROP TABLE {name}")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def all_rows(df):
    return sorted((tuple(r) for r in df.select("id", "v", "p", "q").collect()), key=repr)


def test_upsert_rewrites_what_it_touches(spark, table):
    name, path, df = table
    before = files(path)
    one = df.filter("q = 3 AND p = 'a'").limit(4)
    changes = one.withColumns({"v": F.lit("old"), "seq": F.lit(1)}).unionByName(one.withColumns({"v": F.lit("new"), "seq": F.lit(2)}))
    moved = df.filter("q = 4 AND p IS NULL").limit(2).withColumns({"v": F.lit("m"), "q": F.lit(99), "p": F.lit("x"), "seq": F.lit(1)})
    fresh = spark.createDataFrame([(5000, "n", "b'c", 3, 1)], COLUMNS + ", seq int")
    changes = changes.unionByName(moved).unionByName(fresh)
    want = all_rows(mutations.upsert_by_key(df, changes, ["id"], ["seq"]))
    assert table_changes.upsert_table(spark, name, changes, ["id"], ["seq"]) == 4
    assert all_rows(spark.table(name)) == want
    after = files(path)
    assert len(before & after) == len(before) - 3
    changed = sum(os.path.getsize(f) for f in after - before)
    assert changed < 0.1 * sum(map(os.path.getsize, after))
    assert table_changes.upsert_table(spark, name, changes.limit(0), ["id"], ["seq"]) == 0 and files(path) == after


def test_delete_replace_and_set(spark, table):
    name, path, df = table
    gone = (F.col("q") == 7) & ((F.col("p") == "b'c") | F.col("p").isNull() | (F.col("id") % 2 == 0))
    want = mutations.delete_where(df, gone)
    before = files(path)
    assert table_changes.delete_from_table(spark, name, gone) <= 4
    assert all_rows(spark.table(name)) == all_rows(want)
    assert not any("q=7" in f and ("p=b" in f or "HIVE_DEFAULT" in f) for f in files(path))
    assert all(f in files(path) for f in before if "q=7/" not in f)

    new = spark.createDataFrame([(14, "r", "a", 14), (14, "r2", "a", 14), (39, "r", None, 14)], COLUMNS)
    want = mutations.replace_rows(spark.table(name).select("id", "v", "p", "q"), new, ["id"])
    expected = all_rows(want)
    table_changes.replace_in_table(spark, name, new, ["id"])
    assert all_rows(spark.table(name)) == expected

    changes = spark.createDataFrame([(20, ("s1",), 1), (20, ("s2",), 2), (9999, ("s",), 1)], "id bigint, v struct<v:string>, seq int")
    table_changes.set_fields_in_table(spark, name, changes, "id", ["v"], "seq")
    assert [r.v for r in spark.table(name).filter("id = 20").collect()] == ["s2"]
    assert spark.table(name).filter("id = 9999").count() == 0
    with pytest.raises(ValueError, match="upsert"):
        table_changes.set_fields_in_table(spark, name, changes, "id", ["p"], "seq")
    with pytest.raises(ValueError, match="not partitioned"):
        df.createOrReplaceTempView("plain_view")
        table_changes.partition_columns(spark, "plain_view")


def test_buckets_in_descending_order(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(300), rng.random(), rng.choice("abc")) for _ in range(5000)], "k int, x double, s string")
    left, right = (f"t_{uuid.uuid4().hex[:8]}" for _ in range(2))
    path = str(tmp_path / "left")
    sinks.write_bucketed(df.repartition(7), left, 5, ["k"], ["s", "-x"], path)
    sinks.write_bucketed(df.select("k").distinct(), right, 5, ["k"], ["-k"], str(tmp_path / "right"))
    assert spark.table(left).count() == 5000
    parts = files(path)
    assert len(parts) == 5
    for part in parts:
        rows = pq.read_table(part).to_pylist()
        assert rows == sorted(rows, key=lambda r: (r["s"], -r["x"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(left).join(spark.table(right), "k")
        assert joined.count() == 5000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # A search by the bucket column reads one file.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        one = spark.table(left).filter("k = 17")
        assert "SelectedBucketsCount: 1 out of 5" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    for name in (left, right):
        spark.sql(f"DROP TABLE {name}")
