"""Hot keys, equal rows and random inputs against brute force; shapes of the plans."""

from __future__ import annotations

import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import (
    graph,
    joins,
    keys,
    lineage,
    mutations,
    nested,
    numbering,
    ordering,
    profile,
    projections,
    sets,
)
from millrace.plans.registry import QUERIES
from millrace.scratch import persist_table, release_scratch, scratch_path, scratch_root
from millrace.session import cluster_conf
from millrace.sources import manifests, sinks


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- hot keys and equal rows --------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one key, and many of them are the same row."""
    rng = random.Random(3)
    data = [(0 if i % 3 == 0 else rng.randrange(40), "hot" if i % 6 == 0 else f"v{rng.randrange(9)}")
            for i in range(6000)]
    return data, spark.createDataFrame(data, "k int, v string").repartition(7).cache()


def test_row_numbers_with_equal_rows(skewed):
    data, df = skewed
    got = numbering.number_rows(df, [F.desc("k")], "rn").collect()
    assert sorted(r.rn for r in got) == list(range(1, len(data) + 1))
    in_order = [(r.k, r.v) for r in sorted(got, key=lambda r: r.rn)]
    assert in_order == sorted(data, key=lambda t: (-t[0], t[1]))


def test_equal_rows_are_cut_into_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RUN_CHUNK", 10_000)
    same = spark.range(40_000).select(F.lit(1).alias("k"))
    copies = numbering.number_copies(same, "c")
    assert copies.select("c").distinct().count() == 40_000
    tasks = copies.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r[1] for r in tasks) <= 30_000
    assert ordering.total_order_sort(same, "k").count() == 40_000


def test_total_order(skewed):
    data, df = skewed
    parts = ordering.total_order_sort(df, "k").withColumn("id", F.monotonically_increasing_id())
    got = [(r.k, r.v) for r in sorted(parts.collect(), key=lambda r: r.id)]
    assert got == sorted(data)


@pytest.mark.parametrize(
    "start,end",
    [(0, 5), (990, 1000), (995, 1010), (2500, 2600), (5995, 7000), (3, 3), (5990, None), (0, None)],
)
def test_slices(skewed, start, end):
    data, df = skewed
    ordered = sorted(data, reverse=True)[start:end]
    got = ordering.slice_rows(df, "k", start, end, reverse=True)
    assert Counter(tuple(r) for r in got.collect()) == Counter(ordered)


def test_invalid_positions(skewed):
    _, df = skewed
    for start, end in ((-1, 3), (5, 2)):
        with pytest.raises(ValueError):
            ordering.slice_rows(df, "k", start, end)
    with pytest.raises(ValueError, match="ends after 6000"):
        mutations.delete_row_at(df, ["k"], 6000)


def test_delete_one_of_many_equal_rows(skewed):
    data, df = skewed
    left = Counter(tuple(r) for r in mutations.delete_row_at(df, ["k", "v"], 4).collect())
    assert left == Counter(data) - Counter([sorted(data)[4]])


def test_zip_checks_lengths(spark):
    a = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    b = spark.createDataFrame([("q",), ("p",), ("p",)], "y string")
    assert sorted(tuple(r) for r in projections.zip_columns(a, b, ["x"], ["y"]).collect()) == [
        (1, "p"), (2, "p"), (3, "q")
    ]
    with pytest.raises(ValueError, match="values for a table of"):
        projections.zip_columns(a, b.limit(2), ["x"], ["y"])


def test_roles_and_first_n_of_a_hot_group(spark):
    rows = [(0 if i % 3 else 1 + i % 5, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, i int").repartition(5)
    roles = {(r.g, r.i): r.role for r in projections.assign_roles(df, ["g"], ["i"]).collect()}
    heads = {r.g: r.i for r in ordering.first_n_joined(df, ["g"], "i", ["i"], 3).collect()}
    for g in {g for g, _ in rows}:
        members = sorted(i for h, i in rows if h == g)
        assert [roles[g, i] for i in members[:3]] == ["compute_master", "storage_master", "worker"]
        assert heads[g] == ",".join(map(str, members[:3]))


def test_skewed_values(skewed):
    data, df = skewed
    got = {r.k: r.cnt for r in profile.skewed_values(df, ["k"], 0.2).collect()}
    counts = Counter(k for k, _ in data)
    assert got == {k: n for k, n in counts.items() if n > 0.2 * len(data)}


def test_sort_by_a_vectorised_python_key(spark):
    def last_letter(s: pd.Series) -> pd.Series:
        return s.str[-1]

    key = F.pandas_udf(last_letter, "string")
    df = spark.createDataFrame([("ab",), ("ca",), ("bc",), ("aa",)], "s string")
    got = [r.s for r in ordering.sort_by_expression(df, key("s")).collect()]
    assert got == ["aa", "ca", "ab", "bc"]
    back = [r.s for r in ordering.sort_by_expression(df, F.length("s"), reverse=True).collect()]
    assert back == ["ca", "bc", "ab", "aa"]


def test_sort_rows_breaks_ties_by_the_whole_row(spark):
    df = spark.createDataFrame([(2, "x"), (1, "y"), (3, "x"), (4, None)], "n int, s string")
    assert [r.n for r in ordering.sort_rows(df, "s").collect()] == [4, 2, 3, 1]
    assert [r.n for r in ordering.sort_rows(df, "s", reverse=True).collect()] == [1, 3, 2, 4]
    assert ordering.slice_then_sort(df, ["n"], "s", 1, 3).collect() == [(2, "x"), (3, "x")]
    assert ordering.index_row(df, ["n"], 2).collect() == [(3, "x")]


def test_lineage_against_brute_force(spark):
    rng = random.Random(21)
    base = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 400) if rng.random() < 0.9}
    base |= {f"chain{i}": f"chain{i - 1}" for i in range(1, 130)}
    edges = spark.createDataFrame(list(base.items()), "child string, base string")
    expected = set()
    for child in base:
        at, depth = base[child], 1
        while at is not None:
            expected.add((child, at, depth))
            at, depth = base.get(at), depth + 1
    got = [tuple(r) for r in lineage.base_lineage(edges).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_settings_grow_with_the_input():
    small, large = cluster_conf(1 << 30, 16), cluster_conf(100 << 40, 4000)
    assert int(small["spark.sql.shuffle.partitions"]) == 32
    assert int(large["spark.sql.shuffle.partitions"]) == (100 << 40) // (200 << 20)
    assert small["spark.sql.files.maxPartitionBytes"] == large["spark.sql.files.maxPartitionBytes"]


# -- table changes against brute force ----------------------------------------------------


def test_changes_against_brute_force(spark):
    rng = random.Random(8)
    base = [(k, f"b{k}", float(k)) for k in range(0, 60, 2)]
    changes = []
    for seq in range(400):
        key = 4 if seq % 3 == 0 else rng.randrange(80)
        s = rng.choice([None, ("set", f"s{seq}"), ("set", None)])
        b = rng.choice([None, ("set", float(seq))])
        changes.append((key, seq, s, b))
    expected = {k: [s, b] for k, s, b in base}
    for key, _seq, s, b in changes:
        row = expected.setdefault(key, [None, None])
        if s:
            row[0] = s[1]
        if b:
            row[1] = b[1]
    base_df = spark.createDataFrame(base, "k int, s string, b double")
    change_df = spark.createDataFrame(
        [(k, q, (s[1],) if s else None, (b[1],) if b else None) for k, q, s, b in changes],
        "k int, seq int, s struct<v:string>, b struct<v:double>",
    ).repartition(6)
    got = mutations.set_fields(base_df, change_df, "k", ["s", "b"], "seq")
    assert {r.k: [r.s, r.b] for r in got.collect()} == expected
    known = mutations.set_fields(base_df, change_df, "k", ["s", "b"], "seq", upsert=False)
    assert {r.k for r in known.collect()} == {k for k, _, _ in base}

    puts = spark.createDataFrame(
        [(k, q, f"n{q}", float(q)) for k, q, _, _ in changes], "k int, seq int, s string, b double"
    )
    after = {k: (s, b) for k, s, b in base} | {k: (f"n{q}", float(q)) for k, q, _, _ in changes}
    up = mutations.upsert_by_key(base_df, puts.repartition(6), ["k"], ["seq"])
    assert {r.k: (r.s, r.b) for r in up.collect()} == after

    counted = mutations.increment_counter(
        base_df.selectExpr("k", "2 AS n", "'-' AS last"),
        puts.withColumnRenamed("s", "id"),
        "k", "n", "last", "id", "seq",
    )
    hits = Counter(k for k, *_ in changes)
    assert {r.k: r.n for r in counted.collect()} == {k: 2 + hits[k] for k, _, _ in base}


def test_insert_if_absent_against_brute_force(spark):
    rng = random.Random(4)
    rules = [("10.0.0.1", 80), ("10.0.0.2", 22)]
    reserved = [4000, 5000]
    asked = [
        (rng.choice([3000, 4000, 5000, 6000 + i]), "10.0.0.1" if i % 3 == 0 else f"10.0.0.{rng.randrange(5)}",
         rng.choice([22, 80, 443]), i)
        for i in range(300)
    ]
    held, expected = set(rules), {}
    for port, ip, dest, i in asked:
        ok = port not in reserved and (ip, dest) not in held
        expected[i] = ok
        if ok:
            held.add((ip, dest))
    got = mutations.insert_if_absent(
        spark.createDataFrame(rules, "ip string, port int"),
        spark.createDataFrame(asked, "source_port int, ip string, port int, seq int"),
        spark.createDataFrame([(p,) for p in reserved], "source_port int"),
        ["ip", "port"], "source_port", "seq",
    )
    assert {r.seq: r.accepted for r in got.collect()} == expected


def test_keyed_unions(spark, rows):
    left = spark.createDataFrame([(1, "l"), (2, "l")], "k int, s string")
    right = spark.createDataFrame([(2, "r"), (3, "r")], "k int, s string")
    assert rows(sets.union_right_precedence(left, right, ["k"])) == [(1, "l"), (2, "r"), (3, "r")]
    assert rows(sets.union_left_precedence(left, right, ["k"])) == [(1, "l"), (2, "l"), (3, "r")]


def test_null_predicates_keep_rows(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, s string")
    assert rows(mutations.delete_where(df, F.col("s") == "x"), "k") == [(1,), (3,)]
    assert mutations.clear_rows(df).count() == 0 and mutations.clear_rows(df).columns == ["k", "s"]


# -- paths and documents against brute force ----------------------------------------------


def leads(parent: str, child: str) -> bool:
    p, c = parent.split("/"), child.split("/")
    return len(p) <= len(c) and all(a in ("", b) for a, b in zip(p, c))


@pytest.mark.parametrize("seed", [1000, 0])
def test_path_prefixes(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", ""]
    parents = ["/".join(rng.choices(names, k=rng.randrange(1, 5))) for _ in range(60)]
    children = ["/".join(rng.choices(names, k=rng.randrange(1, 6))) for _ in range(80)]
    pdf = spark.createDataFrame(list(enumerate(parents)), "p int, dir string")
    cdf = spark.createDataFrame(list(enumerate(children)), "c int, url string")
    got = {(r.p, r.c) for r in joins.path_prefix_join(pdf, cdf, "dir", "url").collect()}
    assert got == {(i, j) for i, p in enumerate(parents) for j, c in enumerate(children) if leads(p, c)}


def random_doc(rng, depth):
    doc = {}
    for name in rng.sample("abcde", rng.randrange(1, 5)):
        if depth and rng.random() < 0.5:
            doc[name] = random_doc(rng, depth - 1)
        else:
            doc[name] = rng.choice([1, 2.5, "x", "y", True, None, [1, "z"]])
    return doc


def merged(left, right):
    out = dict(left)
    for key, value in right.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merged(out[key], value)
        else:
            out[key] = value
    return out


def has_conflict(left, right):
    return any(
        key in left and isinstance(value, dict)
        and (not isinstance(left[key], dict) or has_conflict(left[key], value))
        for key, value in right.items()
    )


def paths(doc, at=()):
    for key, value in doc.items():
        if isinstance(value, dict):
            yield from paths(value, (*at, key))
        else:
            yield (*at, key), value


def test_random_documents(spark):
    rng = random.Random(12)
    pairs = []
    while len(pairs) < 60:
        left, right = random_doc(rng, 3), random_doc(rng, 3)
        if not has_conflict(left, right):
            pairs.append((left, right))

    def leaves(which):
        docs = [(i, json.dumps(pair[which])) for i, pair in enumerate(pairs)]
        df = spark.createDataFrame(docs, "id int, doc string")
        return nested.json_leaves(df, "id", "doc").withColumn("value", F.to_json("value"))

    got = nested.merge_config(leaves(0), leaves(1), "id").collect()
    found = {(r.id, tuple(r.path)): json.loads(r.value) for r in got}
    expected = {(i, p): v for i, (left, right) in enumerate(pairs) for p, v in paths(merged(left, right))}
    assert len(got) == len(found) and found == expected


def test_flatten_lists_of_documents(spark):
    docs = [
        [{"type": "a", "n": 1}, {"type": "b", "more": {"x": "1"}}, {"ip": "c"}],
        {"only": "one", "list": ["z"], "deep": {"er": {"k": "v"}}},
        [],
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    got = {}
    for r in nested.flatten_to_pairs(df, "id", "doc", "P").collect():
        got.setdefault(r.id, {})[r.name] = r.value
    assert got == {
        0: {"P_TYPE": "b", "P_LAYER_X": "1", "P_IP": "c"},
        1: {"P_ONLY": "one", "P_LAYER_LAYER_K": "v"},
    }


def test_nested_children(spark):
    stacks = spark.createDataFrame(
        [("A", ["c1", "c9"], [("s1", ["k1", "k2"]), (None, None)]), ("B", [], []), ("C", None, None)],
        "uuid string, connectors array<string>, uuids array<struct<storage:string,compute:array<string>>>",
    ).select("uuid", "connectors", F.struct("uuids").alias("backends"))
    services = spark.createDataFrame(
        [("c1", "e1", None), ("s1", "e2", "u"), ("k2", "e3", None), ("k1", "e4", None)],
        "id string, entry string, uniq string",
    )
    flat_stacks = nested.backend_uuids(stacks).drop("backends")
    classes = {c: c for c in ("connectors", "storage", "compute")}
    got = {r.uuid: r for r in nested.nest_children(flat_stacks, services, "uuid", classes, "id").collect()}
    a = got["A"]
    assert [tuple(x) for x in a.connectors] == [("c1", "e1", None), ("c9", None, None)]
    assert [tuple(x) for x in a.storage] == [("s1", "e2", "u")]
    assert [x.id for x in a.compute] == ["k1", "k2"]
    assert (got["B"].connectors, got["C"].compute) == ([], [])
    salted = nested.nest_children(flat_stacks, services, "uuid", classes, "id", salt=5)
    assert {r.uuid: r for r in salted.collect()} == got


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    left = spark.createDataFrame([(i % 3, i) for i in range(50)] + [(None, -1)], "k int, i int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (7, "d")], "k int, v string")
    plain = keys.salted_join(left, right, ["k"], how, ["i"], 1)
    salted = keys.salted_join(left, right, ["k"], how, ["i"], 8)
    assert salted.columns == plain.columns
    assert Counter(map(tuple, salted.collect())) == Counter(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        keys.salted_join(left, right, ["k"], "full", ["i"], 2)


# -- table layout ---------------------------------------------------------------------------


def test_layout_splits_hot_keys_but_makes_few_files(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(0, 60_000, 1, 12).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("k"),
            F.md5(F.col("id").cast("string")).alias("v"),
        )
        sinks.write_partitioned(df, "laid_out", ["k"], str(tmp_path / "p"))
        files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "p").glob("k=*")}
        assert files["k=hot"] > 1 and sum(files.values()) < 5 * 12
        assert sinks.list_partitions(spark, "laid_out").count() == 5
        assert spark.table("laid_out").count() == 60_000
        one = physical(spark.table("laid_out").filter("k = 'k1'").select("v"))
        assert "PartitionFilters: [isnotnull(k" in one and "ReadSchema: struct<v:string>" in one

        sinks.write_bucketed(df, "in_buckets", 4, ["k"], ["k"], str(tmp_path / "b"))
        names = [f.name for f in (tmp_path / "b").glob("*.parquet")]
        per_bucket = Counter(n.split("_")[1].split(".")[0] for n in names)
        assert len(per_bucket) <= 4 and max(per_bucket.values()) > 1 and len(names) < 4 * 12
        assert spark.table("in_buckets").count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
        for name in ("laid_out", "in_buckets"):
            sinks.drop_table(spark, name)


# -- joins on a hot key --------------------------------------------------------------------


@pytest.fixture
def small_partitions(spark):
    """Adaptive skew handling at a size that a test can reach."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_join_keys_are_split(spark, small_partitions):
    rng = random.Random(1)
    keys = [7 if i % 3 == 0 else rng.randrange(5000) for i in range(60_000)]
    stacks = spark.createDataFrame(
        [(f"sa-{i}", f"s{k}", f"{rng.random()}") for i, k in enumerate(keys)],
        "uuid string, snapshot_uuid string, status string",
    ).repartition(12).withColumn("ts", F.lit("2014-02-05 14:02:00").cast("timestamp_ntz"))
    snaps = spark.createDataFrame([(f"s{k}",) for k in range(3000)], "snapshot_uuid string")
    timed = joins.stacks_with_snapshot_time(stacks, snaps)
    shown = Counter(r.ts != "" for r in timed.collect())
    assert shown[True] == sum(k < 3000 for k in keys)
    assert "skew=true" in physical(timed)

    edges = stacks.select(
        F.col("snapshot_uuid").alias("_outV"), F.col("uuid").alias("_inV"), F.lit("l").alias("_label")
    )
    vertices = snaps.select(F.col("snapshot_uuid").alias("_id"), F.lit("n").alias("name")).union(
        stacks.select("uuid", "status")
    )
    reached = graph.traverse_out(vertices, edges, F.col("name") == "n", "l", "name")
    assert len(reached.collect()) == shown[True]
    assert "skew=true" in physical(reached)

    twice = snaps.union(snaps)
    wanted = joins.required_installed(stacks, twice, "snapshot_uuid")
    assert len(wanted.collect()) == shown[True] and "skew=true" in physical(wanted)
    known = twice.withColumn("status", F.lit("x"))
    kept = sets.union_left_precedence(known, stacks.select("snapshot_uuid", "status"), ["snapshot_uuid"])
    assert len(kept.collect()) == 6000 + shown[False] and "skew=true" in physical(kept)


# -- scratch folder ------------------------------------------------------------------------


def test_scratch_tables(spark):
    df = spark.range(5).withColumn("s", F.lit("x"))
    kept = persist_table(df, "kept")
    assert kept.dtypes == df.dtypes and kept.count() == 5
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


# -- plans ---------------------------------------------------------------------------------


def test_no_query_plans_a_cartesian_product(spark, sf_dir):
    slow = {"train_als", "predict_pairs", "train_kmeans", "train_logistic", "logistic_training_error"}
    for key, query in QUERIES.items():
        if key not in slow:
            text = physical(query(spark, sf_dir))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, key


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = physical(QUERIES["filter_range_count"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(user_id), LessThan(user_id,10)]" in text
    assert "ReadSchema: struct<user_id:bigint>" in text
    text = physical(QUERIES["filter_by_constraints"](spark, sf_dir))
    assert "EqualNullSafe(o_orderstatus,F)" in text


@pytest.mark.parametrize("key", ["assign_roles", "first_n_joined", "upsert_by_key", "slice_rows"])
def test_rank_limits_are_applied_before_the_shuffle(spark, sf_dir, key):
    text = physical(QUERIES[key](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_bucketed_tables_join_without_a_shuffle(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = physical(QUERIES["write_bucketed"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_row_jobs_have_no_shuffle(spark, sf_dir):
    for key in ("classify_messages", "derive_sizing", "substitute_template", "client_services_for_backends",
                "fn_string", "fn_map_json", "version_compare", "expand_instances"):
        assert "Exchange" not in physical(QUERIES[key](spark, sf_dir)), key
    # The lines of logs are read by tasks that file names are dealt to; parsing them moves nothing.
    lines = spark.createDataFrame([("/logs/sa-1/storage/a.log", "x")], "path string, line string")
    assert "Exchange" not in physical(manifests.parse_logs(lines))


def test_no_row_at_a_time_python(spark, sf_dir):
    for key in ("word_count", "format_report_columns", "assign_clusters", "in_degree"):
        text = physical(QUERIES[key](spark, sf_dir))
        assert "Python" not in text and "Arrow" not in text, key
    # JSON tokens are read in Arrow batches, and nothing is shuffled before the pairs are grouped.
    text = physical(QUERIES["flatten_to_pairs"](spark, sf_dir))
    assert "MapInArrow" in text and "EvalPython" not in text and "Pandas" not in text


def test_release_scratch_removes_the_folder(spark):
    import os

    root = scratch_root(spark)
    persist_table(spark.range(1), "gone")
    assert os.path.isdir(root)
    release_scratch(spark)
    assert not os.path.exists(root)
