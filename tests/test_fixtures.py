"""Exact results on small inputs."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates, filters, graph, joins, learning, lineage, mutations, nested
from millrace.operators.aggregates import degree_histogram
from millrace.sources import files, graph_json, manifests, sinks

RATINGS = "1\t10\t5\t881250949\n1\t11\t3\t881250950\n2\t10\t4\t881250951\n12\t10\t1\t881250952\nx\t11\t2\t881250953\n"


def test_delimited_ratings(spark, tmp_path, rows):
    (tmp_path / "u.data").write_text(RATINGS)
    df = files.scan_delimited(spark, str(tmp_path), files.RATINGS_SCHEMA)
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "int", "int", "string"]
    assert df.filter("userid IS NULL").count() == 1
    assert filters.filter_range_count(df, "userid", 10).first().cnt == 3
    counts = aggregates.count_by_key(df, "userid").collect()
    assert {r.userid: r.cnt for r in counts} == {1: 2, 2: 1, 12: 1, None: 0}


# The vertices and edges of the small mythology graph.
GODS = [
    (0, "saturn", "titan"), (1, "jupiter", "god"), (2, "neptune", "god"), (3, "pluto", "god"),
    (4, "sky", "location"), (5, "sea", "location"), (6, "tartarus", "location"),
    (7, "hercules", "demigod"), (8, "alcmene", "human"), (9, "nemean", "monster"),
    (10, "hydra", "monster"), (11, "cerberus", "monster"),
]
GOD_EDGES = [
    (12, 1, 0, "father"), (13, 4, 1, "lives"), (14, 3, 1, "brother"), (15, 1, 3, "brother"),
    (16, 2, 1, "brother"), (17, 1, 2, "brother"), (18, 0, 1, "father"), (19, 5, 2, "lives"),
    (20, 3, 2, "brother"), (21, 2, 3, "brother"), (22, 2, 1, "brother"), (23, 1, 2, "brother"),
]


@pytest.fixture
def gods(spark, tmp_path):
    doc = {
        "graph": {
            "mode": "NORMAL",
            "vertices": [{"_id": i, "name": n, "type": t, "_type": "vertex"} for i, n, t in GODS],
            "edges": [
                {"_id": i, "_type": "edge", "_outV": o, "_inV": v, "_label": label}
                for i, o, v, label in GOD_EDGES
            ],
        }
    }
    (tmp_path / "gods.json").write_text(json.dumps(doc, indent=2))
    return graph_json.scan_property_graph(spark, str(tmp_path))


def test_property_graph(gods, rows):
    v, e = gods
    assert (v.count(), e.count()) == (12, 12)
    assert rows(filters.filter_by_property(v, "name", "pluto"), "_id") == [(3,)]
    names = rows(graph.traverse_out(v, e, F.col("name") == "pluto", "brother", "name"), "name")
    assert names == [("jupiter",), ("neptune",)]
    bag = rows(graph.traverse_out(v, e, F.col("name") == "jupiter", "brother", "name"), "name")
    assert bag == [("neptune",), ("neptune",), ("pluto",)]
    assert rows(graph.out_ids(e, 3)) == [(1,), (2,)]
    degrees = graph.in_degree(v, e)
    assert rows(degree_histogram(degrees)) == sorted([(0, 8), (1, 1), (2, 1), (4, 1), (5, 1)], key=repr)
    assert degrees.agg(F.sum("degree")).first()[0] == 12


@pytest.mark.parametrize("n", [1, 2, 100, 5000])
def test_generated_graph(spark, n):
    edges = graph.generate_attachment_graph(spark, n, seed=5).collect()
    assert sorted(r.src for r in edges) == list(range(1, n + 1))
    assert all(0 <= r.dst < r.src for r in edges)
    # The same draws resolved one after the other.
    from millrace.functions.hashing import stable_hash

    slot = F.pmod(stable_hash(5, F.col("id")), F.lit(2) * F.col("id") - 1)
    drawn = spark.range(1, n + 1).select(F.col("id").alias("src"), slot.alias("slot")).collect()
    slots = {r.src: r.slot for r in drawn}
    bag, expected = [0], {}
    for i in range(1, n + 1):
        expected[i] = bag[slots[i]]
        bag += [expected[i], i]
    assert {r.src: r.dst for r in edges} == expected


def test_users_by_key(spark, rows):
    users = spark.createDataFrame(
        [(1745, "john", "smith"), (1744, "john", "doe"), (1746, "john", "smith")],
        "user_id int, fname string, lname string",
    )
    assert rows(filters.lookup_by_secondary_key(users, "lname", "smith"), "user_id") == [(1745,), (1746,)]
    again = users.withColumn("seq", F.lit(1))
    assert rows(mutations.upsert_by_key(users, again, ["user_id"], ["seq"])) == rows(users)


@pytest.fixture
def stacks(spark):
    clusters = spark.createDataFrame(
        [("A", "hadoop", "s1", "running"), ("B", "spark", "x", "stopped"), ("C", "mpi", "y", "removed")],
        "uuid string, base string, snapshot_uuid string, status string",
    ).withColumn("ts", F.lit("2014-02-05 14:02:00").cast("timestamp_ntz"))
    snaps = spark.createDataFrame([("s1", "A"), ("s9", "gone")], "snapshot_uuid string, cluster_uuid string")
    return clusters, snaps.withColumn("snapshot_ts", F.lit("2014-02-05 14:02:00").cast("timestamp_ntz"))


def test_stack_and_snapshot_queries(stacks, rows):
    clusters, snaps = stacks
    when = "02/3/2014 (02:02 PM)"
    assert rows(joins.snapshots_with_base(snaps, clusters)) == [("s1", "hadoop", when)]
    timed = joins.stacks_with_snapshot_time(clusters, snaps)
    assert rows(timed, "uuid", "ts") == [("A", when), ("B", ""), ("C", "")]
    live = mutations.delete_where(clusters, F.col("status") == "removed")
    assert rows(live, "uuid") == [("A",), ("B",)]


def test_transitions(spark, stacks, rows):
    clusters, _ = stacks
    asked = spark.createDataFrame(
        [("A", "rm"), ("B", "rm"), ("A", "stop"), ("B", "stop"), ("Z", "rm"), ("A", "snapshot")],
        "uuid string, action string",
    )
    refusal = "Stack is running. Please stop first"
    assert rows(mutations.guarded_transition(asked, clusters, "uuid")) == sorted(
        [
            ("A", "rm", False, refusal, "running"),
            ("B", "rm", True, "removed", "removed"),
            ("A", "stop", True, "stopped", "stopped"),
            ("B", "stop", True, "running", "stopped"),
            ("Z", "rm", False, refusal, None),
            ("A", "snapshot", True, "running", "running"),
        ],
        key=repr,
    )


# Names and bases of a set of image files, by directory.
IMAGES = {
    "tool-base": ("ubuntu:14.04", ["tool-base"]),
    "cassandra": ("$USER/tool-base", ["cassandra"]),
    "gluster": ("$USER/tool-base", ["gluster"]),
    "mongodb": ("$USER/tool-base", ["mongodb", "mongodb-client"]),
    "hadoop-base": ("$USER/gluster", ["hadoop-base"]),
    "openmpi": ("$USER/gluster", ["openmpi"]),
    "hadoop": ("$USER/hadoop-base", ["hadoop", "yarn"]),
    "hadoop-client": ("$USER/hadoop-base", ["hadoop-client"]),
    "hive-metastore": ("$USER/hadoop-base", ["hive-metastore", "hive"]),
    "spark": ("$USER/hadoop-base", ["spark", "spark-client"]),
    "openmpi-client": ("$USER/openmpi", ["openmpi-client"]),
    "titan": ("$USER/cassandra", ["titan"]),
    "cassandra-client": ("$USER/titan", ["cassandra-client"]),
}


def test_image_lineage(spark, tmp_path):
    for name, (base, aliases) in IMAGES.items():
        folder = tmp_path / name
        folder.mkdir()
        text = f"FROM {base}\n" + "".join(f"name {a}\n" for a in aliases) + "\nRUN true\nFROM later\n"
        (folder / "Dockerfile").write_text(text)
    found = manifests.scan_directives(spark, str(tmp_path), ["NAME", "FROM"])
    edges = manifests.directive_bases(found)
    assert edges.count() == sum(len(a) for _, a in IMAGES.values())
    tree = lineage.base_lineage(edges)
    chains = {}
    for r in tree.collect():
        chains.setdefault(r.child, {})[r.depth] = r.ancestor
    in_order = {c: [a[d] for d in sorted(a)] for c, a in chains.items()}
    assert in_order["spark"] == ["hadoop-base", "gluster", "tool-base", "ubuntu:14.04"]
    assert in_order["cassandra-client"] == ["titan", "cassandra", "tool-base", "ubuntu:14.04"]
    steps = {r.name: r.step for r in lineage.build_order(edges).collect()}
    assert steps["ubuntu:14.04"] == 0 and all(steps[r.child] > steps[r.base] for r in edges.collect())


def test_lineage_reports_a_cycle(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, base string")
    with pytest.raises(ValueError, match="cycle"):
        lineage.base_lineage(loop)


def test_message_classes(spark):
    texts = ["ssh:\nNo route to host\n", "Connection closed", "x Connection refused", "timed ou", "timed out",
             "Permission denied (key)", "fine", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    got = {r.i: (r.reason, r.retryable) for r in filters.classify_messages(df, "m").collect()}
    expected = ["no_route", "closed", "refused", "timed_out", "timed_out", "denied", "other", "other"]
    assert got == {i: (e, e != "other") for i, e in enumerate(expected)}


def test_instance_dimension(spark, rows):
    dim = joins.instance_dimension(spark)
    assert dim.count() == 23
    asked = spark.createDataFrame([("t2.small",), ("m3.medium",), ("nope",)], "instance_type string")
    found = joins.lookup_with_default(asked, dim, "instance_type", {"mem_mb": 1024, "cores": 1})
    assert rows(found) == [("m3.medium", 3840, 1), ("nope", 1024, 1), ("t2.small", 2048, 1)]


def leaves(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    out = nested.json_leaves(df, "id", "doc")
    return out.withColumn("value", F.col("value").cast("string"))


def test_merge_and_flatten(spark, rows):
    left = leaves(spark, [{"a": 1, "b": {"c": 2, "d": 3}, "e": {"f": 1}}])
    right = leaves(spark, [{"b": {"c": 9}, "e": 5, "g": 7}])
    merged = nested.merge_config(left, right, "id")
    got = {".".join(r.path): r.value for r in merged.collect()}
    assert got == {"a": "1", "b.c": "9", "b.d": "3", "e": "5", "g": "7"}

    doc = {"type": "hadoop", "ip": "10.0.0.1", "n": 3, "layer": {"db": "x", "port": 1}, "l": ["z"]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    pairs = nested.flatten_to_pairs(df, "id", "doc", "P")
    assert rows(pairs, "name", "value") == sorted(
        [("P_TYPE", "hadoop"), ("P_IP", "10.0.0.1"), ("P_LAYER_DB", "x")], key=repr
    )


def test_merge_conflict(spark):
    left, right = leaves(spark, [{"e": 5, "k": 1}]), leaves(spark, [{"e": {"f": 1}}])
    with pytest.raises(Exception, match="meets a subtree at e"):
        nested.merge_config(left, right, "id").collect()
    loose = nested.merge_config(left, right, "id", strict=False).collect()
    assert {".".join(r.path): r.value for r in loose} == {"k": "1", "e.f": "1"}


@pytest.mark.parametrize("depth", [1, 2, 5, 9, 20])
def test_leaves_of_any_depth(spark, depth):
    doc = "lost"
    for _ in range(depth):
        doc = {"a": doc, "]{": "\\\"}"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}")], "id int, doc string")
    found = nested.json_leaves(df, "id", "doc")
    assert found.count() == depth + 1
    assert nested.json_leaves(df, "id", "doc", keep_empty=True).count() == depth + 2
    assert sorted(str(r.value) for r in found.select("value").collect()).count('"lost"') == 1
    pairs = {r.name: r.value for r in nested.flatten_to_pairs(df, "id", "doc", "P").collect()}
    assert pairs["P" + "_LAYER" * (depth - 1) + "_A"] == "lost"


def test_lists_of_lists_contribute_their_objects(spark):
    doc = [[{"k": "v", "n": [{"x": "no"}]}], {"k": "w", "o": {"m": "u"}}, [[{"z": "y"}]]]
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    pairs = {r.name: r.value for r in nested.flatten_to_pairs(df, "id", "doc", "P").collect()}
    assert pairs == {"P_K": "w", "P_LAYER_M": "u", "P_Z": "y"}


def test_long_chain_in_few_rounds(spark):
    n = 3000
    chain = spark.range(1, n).selectExpr("id as child", "id - 1 as base")
    steps = {r.name: r.step for r in lineage.build_order(chain).collect()}
    assert steps == {i: i for i in range(n)}
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, base string")
    with pytest.raises(ValueError, match="cycle"):
        lineage.build_order(loop)


def test_sorts_keep_every_cell(spark):
    from millrace.operators import mutations, numbering, ordering, projections

    nan = float("nan")
    cells = [(1, -0.0, [-0.0]), (1, 0.0, [0.0]), (2, -0.0, [nan]), (2, -0.0, [nan])]
    df = spark.createDataFrame(cells, "k int, x double, a array<double>")
    frames = [
        ordering.sort_rows(df, "k"), ordering.total_order_sort(df, "k"), numbering.number_rows(df, "k"),
        ordering.slice_rows(df, "k", 0, 4), ordering.slice_rows(df, "k", 0, 5000),
    ]
    for frame in frames:
        assert sorted(str((r.k, r.x, r.a)) for r in frame.collect()) == sorted(map(str, cells))
    left = mutations.delete_row_at(df, ["k"], 3).collect()
    assert sorted(str((r.k, r.x, r.a)) for r in left) == sorted(map(str, cells[:3]))


def test_keys_beyond_int(spark):
    actual = spark.createDataFrame([(3_000_000_000, 1, 2.0)], "user bigint, item bigint, rating double")
    predicted = spark.createDataFrame([(3e9, 1.0, 1.5)], "user double, item double, prediction double")
    assert joins.join_actual_predicted(actual, predicted).count() == 1


# Six points around two centres, and sixteen ratings of two tastes.
POINTS = [0.0, 0.1, 0.2, 9.0, 9.1, 9.2]
TASTES = [(u, i, 5.0 if (u <= 2) == (i % 2 == 1) else 1.0) for u in range(1, 5) for i in range(1, 5)]


def test_factors_of_large_and_named_ids(spark):
    known = spark.createDataFrame([(u + 3_000_000_000, f"item {i}", r) for u, i, r in TASTES], "user bigint, item string, rating double")
    factors = learning.train_als(known)
    asked = known.select("user", "item").union(spark.createDataFrame([(7, "item 1"), (None, "item 1")], "user bigint, item string"))
    predicted = learning.predict_pairs(factors, asked)
    assert dict(predicted.dtypes)["user"] == "bigint" and predicted.count() == known.count()
    assert {r.user for r in predicted.collect()} == {r.user for r in known.collect()}


def test_kmeans_needs_as_many_points_as_clusters(spark):
    one = learning.vectors(spark.createDataFrame([([1.0],), ([1.0],)], "p array<double>"), "p")
    with pytest.raises(ValueError, match="distinct points"):
        learning.train_kmeans(one)


def test_names_and_places_that_need_quotes(spark, tmp_path):
    name = f"{abs(hash(str(tmp_path)))}_select"
    before = spark.catalog.currentDatabase()
    sinks.create_database(spark, name, str(tmp_path / "it's here"))
    try:
        sinks.convert_to_columnar(spark.range(3), "table")
        assert spark.table("`table`").count() == 3
        sinks.drop_table(spark, f"{name}.table")
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {sinks.quoted_name(name)} CASCADE")


def test_kmeans_golden(spark, tmp_path):
    (tmp_path / "kmeans.data").write_text("".join(f"{p} {p} {p}\n" for p in POINTS))
    points = files.scan_vectors(spark, str(tmp_path))
    model = learning.train_kmeans(learning.vectors(points, "point"), runs=5)
    centres = sorted(tuple(round(float(x), 6) for x in c) for c in model.clusterCenters())
    assert centres == [(0.1,) * 3, (9.1,) * 3]
    placed = learning.assign_clusters(points, learning.centres_frame(spark, model), "point")
    total = placed.agg(F.sum("distance")).first()[0]
    assert total == pytest.approx(4 * 0.1 * math.sqrt(3), abs=1e-9)


def test_als_golden(spark, tmp_path):
    (tmp_path / "als.data").write_text("".join(f"{u},{i},{r}\n" for u, i, r in TASTES))
    ratings = files.scan_ratings(spark, str(tmp_path))
    predicted = learning.predict_pairs(learning.train_als(ratings), ratings)
    both = joins.join_actual_predicted(ratings, predicted)
    assert both.count() == 16
    assert aggregates.mean_squared_error(both, "rating", "prediction").first().mse == pytest.approx(4.0, abs=0.05)


def test_linear_with_and_without_intercept(spark, tmp_path):
    lines = [f"{3.0 + 2.0 * x - y},{x} {y}\n" for x in range(6) for y in range(5)]
    (tmp_path / "lpsa.data").write_text("".join(lines))
    points = files.scan_labeled_points(spark, str(tmp_path))
    ready = learning.labelled(points, F.col("label"), F.col("features"))
    model = learning.train_linear(ready)
    assert [round(float(c), 6) for c in model.coefficients] == [2.0, -1.0]
    assert model.intercept == pytest.approx(3.0)
    flat = learning.train_linear(ready, fit_intercept=False)
    assert flat.intercept == 0.0 and flat.summary.meanSquaredError > 0.1


def test_logistic_separates_planted_classes(spark):
    data = [(float(x > 10), [float(x), float(x % 3)]) for x in range(21)]
    df = spark.createDataFrame(data, "y double, x array<double>")
    points = learning.labelled(df, F.col("y"), F.col("x"))
    scored = learning.train_logistic(points).transform(points)
    assert aggregates.training_error(scored, "label", "prediction").first().error == 0.0


def test_pi(spark):
    assert learning.estimate_pi(spark, 200_000).first().pi == pytest.approx(math.pi, abs=0.02)


YAML = """
metadata:
  author: Jane
  version: 0.2.0
  description: A framework for large data sets
  icon: a.png
  tags: [x, y]
  url: http://example.com/
params:
  resolver: r
questions:
  - question: how many
    param: "{instances}"
backend:
  - storage:
      personality: hadoop
      instances: "{instances}"
      layers: [hive]
connectors:
  - personality: client
"""


def test_manifest_tree(spark, tmp_path):
    sub = tmp_path / "one" / "two"
    sub.mkdir(parents=True)
    (sub / "big.app.yaml").write_text(YAML)
    plain = {
        "metadata": {"author": "J", "version": "1", "description": "short", "tags": [], "url": "u"},
        "params": {}, "backend": [], "connectors": [],
    }
    (tmp_path / "one" / "plain.json").write_text(json.dumps(plain, indent=1))
    (tmp_path / "bare.yml").write_text("params: {}\n")
    (tmp_path / "notes.txt").write_text("not a manifest")
    apps = {r.name: r for r in manifests.scan_manifests(spark, str(tmp_path)).collect()}
    assert set(apps) == {"big.app", "plain", "bare"}
    big, plain, bare = apps["big.app"], apps["plain"], apps["bare"]
    assert (big.author, big.version, big.short) == ("Jane", "0.2.0", "A framework for large...")
    assert big.questions[0].param == "{instances}" and big.plan.backend[0].storage.layers == ["hive"]
    assert big.file.endswith("/one/two/big.app.yaml") and big.icon == "a.png"
    assert (plain.questions, plain.icon, plain.short) == ([], "", "short...")
    assert (bare.author, bare.short, bare.file, bare.tags) == ("Unknown", "", "", [])
    assert [r.name for r in manifests.scan_manifests(spark, str(tmp_path), "plain").collect()] == ["plain"]
    names = {r.name for r in manifests.relative_names(spark, str(tmp_path)).collect()}
    assert names == {"one/two/big.app.yaml", "one/plain.json", "bare.yml", "notes.txt"}


def test_log_trees(spark, tmp_path, rows):
    logs = {"sa-1/storage/a.log": "x\ny\n", "sa-1/compute/n/b.log": "z\n", "sa-1/other/c.log": "w\n"}
    for place, text in logs.items():
        file = tmp_path / place
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    assert rows(manifests.collect_logs(spark, str(tmp_path))) == sorted(
        [("sa-1", "storage", "a.log", "x"), ("sa-1", "storage", "a.log", "y"), ("sa-1", "compute", "n/b.log", "z")],
        key=repr,
    )


def test_job_output_is_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    path = str(tmp_path / "out")
    sinks.write_job_output(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_job_output(df, path)


def test_profile_of_every_kind_of_column(spark):
    from millrace.operators.profile import profile_columns

    df = spark.createDataFrame(
        [(True, 1, 1.5, "ab", "9.99"), (False, None, -2.0, "abcd", "10.00"), (True, 7, None, None, None)],
        "b boolean, i int, d double, s string, c string",
    ).withColumn("c", F.col("c").cast("decimal(6,2)"))
    got = {r.column_name: r for r in profile_columns(df, exact=True).collect()}
    assert (got["b"].num_trues, got["b"].num_falses, got["b"].num_nulls) == (2, 1, 0)
    assert (got["i"].long_low, got["i"].long_high, got["i"].num_nulls) == (1, 7, 1)
    assert (got["d"].double_low, got["d"].double_high) == (-2.0, 1.5)
    assert (got["s"].avg_length, got["s"].max_length, got["s"].num_distincts) == (3.0, 4, 2)
    assert (got["c"].decimal_low, got["c"].decimal_high, got["c"].column_type) == ("9.99", "10.00", "decimal(6,2)")
    by = profile_columns(df, ["b"], exact=True).filter("b AND column_name = 'i'").first()
    assert (by.long_low, by.long_high, by.num_nulls) == (1, 7, 0)


def test_word_statistics(spark, rows):
    lines = spark.createDataFrame([("a bb  ccc",), ("dddd\ta",)], "line string")
    assert rows(aggregates.word_count(lines, "line")) == [("a", 2), ("bb", 1), ("ccc", 1), ("dddd", 1)]
    assert aggregates.word_mean(lines, "line").first().mean_length == pytest.approx(11 / 5)
    even = spark.createDataFrame([("a bb ccc dddd",)], "line string")
    assert aggregates.word_median(even, "line").first().median_length == 2
    assert tuple(filters.lines_containing(lines, {"a": "a", "b": "b"}).first()) == (2, 1)
