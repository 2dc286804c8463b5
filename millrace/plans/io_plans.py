"""Sources and sinks on the test tables; files go to the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.dates import epoch_seconds
from millrace.plans.join_plans import ratings
from millrace.plans.registry import plan
from millrace.scratch import scratch_path
from millrace.sources import files, generated, graph_json, manifests, sinks, trees


def _fresh(name: str) -> str:
    """A table name that no other run uses."""
    return f"{name}_{uuid.uuid4().hex[:12]}"


# -- sources ----------------------------------------------------------------------------


@plan(
    "scan_delimited",
    """
    SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END::INTEGER AS userid,
           event_id::INTEGER AS movieid, floor(value)::INTEGER AS rating,
           floor(epoch(ts))::BIGINT::VARCHAR AS unixtime
    FROM events
    """,
)
def _(t):
    path = scratch_path(t.spark, "ratings")
    bad = F.when(F.col("event_type") == "error", F.lit("x")).otherwise(F.col("user_id").cast("string"))
    seconds = epoch_seconds(F.col("ts"))
    rows = t.events.select(
        bad.alias("userid"), F.col("event_id"), F.floor("value").alias("rating"), seconds.alias("unixtime")
    )
    sinks.write_job_output(rows, path)
    return files.scan_delimited(t.spark, path, files.RATINGS_SCHEMA)


@plan(
    "scan_lines",
    """
    SELECT line, count(*) AS cnt FROM (
      SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line
    """,
)
def _(t):
    path = scratch_path(t.spark, "lines")
    t.documents.select("text").write.text(path)
    return files.scan_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("cnt"))


@plan(
    "scan_vectors",
    """
    SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total
    FROM embeddings
    """,
)
def _(t):
    path = scratch_path(t.spark, "vectors")
    numbers = F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>"))
    line = F.concat_ws(" ", numbers.cast("array<string>"))
    t.embeddings.select(line).write.text(path)
    point = files.scan_vectors(t.spark, path)
    values = F.slice("point", F.lit(2), F.size("point") - 1)
    return point.select(
        F.get("point", F.lit(0)).cast("bigint").alias("vec_id"),
        F.size(values).cast("bigint").alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
    )


@plan(
    "scan_ratings",
    """
    SELECT o_custkey::BIGINT AS user, l_partkey::BIGINT AS item, round(avg(l_quantity), 4) AS rating
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    """,
)
def _(t):
    path = scratch_path(t.spark, "als")
    rows = ratings(t).withColumns({"user": F.col("user").cast("double"), "item": F.col("item").cast("double")})
    rows.select("user", "item", "rating").write.csv(path)
    return files.scan_ratings(t.spark, path).withColumn("rating", F.round("rating", 4))


@plan(
    "scan_labeled_points",
    """
    SELECT l_quantity AS label, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3, 3 AS width FROM lineitem
    """,
)
def _(t):
    path = scratch_path(t.spark, "labelled")
    features = F.concat_ws(" ", "l_extendedprice", "l_discount", "l_tax")
    t.lineitem.select(F.concat_ws(",", F.col("l_quantity").cast("string"), features)).write.text(path)
    points = files.scan_labeled_points(t.spark, path)
    return points.select(
        "label",
        *[F.element_at("features", i).alias(f"f{i}") for i in (1, 2, 3)],
        F.size("features").alias("width"),
    )


@plan(
    "scan_property_graph",
    """
    SELECT 'vertex' AS kind, c_mktsegment AS tag, count(*) AS n, sum(c_custkey)::BIGINT AS ids
    FROM customer GROUP BY ALL
    UNION ALL
    SELECT 'edge', o_orderpriority, count(*), sum(o_custkey)::BIGINT FROM orders GROUP BY o_orderpriority
    """,
)
def _(t):
    path = scratch_path(t.spark, "graph")
    vertex = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"),
        F.col("c_custkey").alias("_id"), F.lit("vertex").alias("_type"),
    )
    edge = F.struct(
        F.col("o_orderkey").alias("_id"), F.lit("edge").alias("_type"), F.col("o_orderkey").alias("_outV"),
        F.col("o_custkey").alias("_inV"), F.col("o_orderpriority").alias("_label"),
    )
    # One document per record: a graph of any size is many small documents.
    t.customer.select(F.struct(F.array(vertex).alias("vertices")).alias("graph")).write.json(path)
    t.orders.select(F.struct(F.array(edge).alias("edges")).alias("graph")).write.mode("append").json(path)
    v, e = graph_json.scan_property_graph(t.spark, path, one_document_per_file=False)
    size, ids = F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    rows = v.select(F.lit("vertex").alias("kind"), F.col("type").alias("tag"), F.col("_id").alias("id"))
    rows = rows.union(e.select(F.lit("edge"), F.col("_label"), F.col("_inV")))
    return rows.groupBy("kind", "tag").agg(size, ids)


@plan(
    "scan_large_graph",
    """
    SELECT 'vertex' AS kind, c_mktsegment AS tag, count(*) AS n, sum(c_custkey)::BIGINT AS ids
    FROM customer GROUP BY ALL
    UNION ALL
    SELECT 'edge', o_orderpriority, count(*), sum(o_custkey)::BIGINT FROM orders GROUP BY o_orderpriority
    """,
)
def _(t):
    """The whole graph as one document, which many tasks read again."""
    root = scratch_path(t.spark, "graph")
    vertex = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("_id")))
    edge = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("_id"), F.col("o_orderkey").alias("_outV"), F.col("o_custkey").alias("_inV"),
            F.col("o_orderpriority").alias("_label"), F.lit('a "quoted" ]} \\').alias("note"),
        )
    )

    def part(df, section, key, text):
        first = df.agg(F.min(key)).scalar()
        return df.select(
            F.lit(section).alias("section"), F.col(key).cast("bigint").alias("at"),
            F.concat(F.when(F.col(key) == first, "").otherwise(","), text).alias("content"),
        )

    frame = [(0, 0, '{"graph": {"mode": "NORMAL", "vertices": ['), (2, 0, '], "edges" : ['), (4, 0, "]}}\n")]
    rows = t.spark.createDataFrame(frame, "section int, at bigint, content string")
    rows = rows.unionByName(part(t.customer, 1, "c_custkey", vertex)).unionByName(part(t.orders, 3, "o_orderkey", edge))
    trees.write_files(rows, root, F.lit("graph.json"), F.col("content"), ["section", "at"])
    v, e = graph_json.scan_large_graph(t.spark, root, chunk_bytes=1 << 17)
    size, ids = F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    found = v.select(F.lit("vertex").alias("kind"), F.col("type").alias("tag"), F.col("_id").alias("id"))
    found = found.union(e.select(F.lit("edge"), F.col("_label"), F.col("_inV")))
    return found.groupBy("kind", "tag").agg(size, ids)


@plan(
    "scan_documents",
    """
    SELECT 'sa-' || o_orderkey AS uuid, o_orderstatus AS status, 'se-' || o_custkey AS storage,
           1 AS computes, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS base
    FROM orders
    """,
)
def _(t):
    path = scratch_path(t.spark, "clusters")
    service = F.concat(F.lit("se-"), "o_custkey")
    backend = F.struct(service.alias("storage"), F.array(service).alias("compute"))
    docs = t.orders.select(
        F.concat(F.lit("sa-"), "o_orderkey").alias("uuid"),
        F.col("o_orderstatus").alias("status"),
        F.struct(F.array(backend).alias("uuids")).alias("backends"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("base"),
        F.col("o_totalprice").alias("not_declared"),
    )
    docs.write.json(path)
    schema = (
        "uuid string, status string, base string,"
        "backends struct<uuids:array<struct<storage:string,compute:array<string>>>>"
    )
    first = F.get("backends.uuids", F.lit(0))
    return files.scan_documents(t.spark, path, schema).select(
        "uuid", "status", first["storage"].alias("storage"), F.size(first["compute"]).alias("computes"), "base"
    )


def directive_tree(t):
    """A folder with a directive file of one or two names and one or two bases for each part."""
    content = F.concat(
        F.lit("\nname  part-"), "p_partkey", F.lit("\n\nFROM repo/sub/"), "p_type", F.lit("\n"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("NAME alias-"), "p_partkey", F.lit("\nfrom other/base\n")))
        .otherwise(F.lit("RUN echo NAME none\n")),
    )
    root = scratch_path(t.spark, "images")
    trees.write_files(t.part, root, F.concat(F.lit("images/part"), "p_partkey", F.lit("/Dockerfile")), content)
    return root


@plan(
    "scan_directives",
    """
    WITH p AS (SELECT '/images/part' || p_partkey || '/Dockerfile' AS path, * FROM part)
    SELECT path, 1 AS line_no, 'NAME' AS keyword, 'part-' || p_partkey AS argument FROM p
    UNION ALL SELECT path, 3, 'FROM', 'repo/sub/' || p_type FROM p
    UNION ALL SELECT path, 4, 'NAME', 'alias-' || p_partkey FROM p WHERE p_size > 25
    UNION ALL SELECT path, 5, 'FROM', 'other/base' FROM p WHERE p_size > 25
    """,
)
def _(t):
    root = directive_tree(t)
    found = manifests.scan_directives(t.spark, root, ["name", "FROM"])
    return found.withColumn("path", F.replace("path", F.lit(root), F.lit("")))


@plan(
    "directive_bases",
    """
    SELECT 'part-' || p_partkey AS child, p_type AS base FROM part
    UNION ALL SELECT 'alias-' || p_partkey, p_type FROM part WHERE p_size > 25
    """,
)
def _(t):
    return manifests.directive_bases(manifests.scan_directives(t.spark, directive_tree(t), ["NAME", "FROM"]))


@plan(
    "collect_logs",
    """
    SELECT 'sa-' || user_id AS stack, CASE event_type WHEN 'view' THEN 'storage' ELSE 'compute' END AS class,
           event_type || '/node.log' AS path, 'event ' || event_id AS line
    FROM events WHERE event_type <> 'error'
    """,
)
def _(t):
    place = (
        F.when(F.col("event_type") == "view", "storage")
        .when(F.col("event_type") == "error", "connectors")
        .otherwise("compute")
    )
    path = F.concat_ws("/", F.lit("logs"), F.concat(F.lit("sa-"), "user_id"), place, "event_type", F.lit("node.log"))
    root = scratch_path(t.spark, "logs")
    trees.write_files(t.events, root, path, F.concat(F.lit("event "), "event_id", F.lit("\n")), ["event_id"])
    return manifests.collect_logs(t.spark, root)


@plan(
    "union_distinct_tree",
    "SELECT DISTINCT p_brand || '/' || p_name AS name FROM part",
)
def _(t):
    root = scratch_path(t.spark, "apps")
    trees.write_files(t.part, root, F.concat_ws("/", "p_brand", "p_name"), F.concat("p_type", F.lit("\n")), ["p_partkey"])
    return manifests.relative_names(t.spark, root)


@plan(
    "generate_records",
    """
    SELECT upper(left(md5('1-' || id), 10)) AS key, lpad(id::VARCHAR, 90, '0') AS payload
    FROM range((SELECT count(*) FROM lineitem)) g(id)
    """,
)
def _(t):
    return generated.generate_records(t.spark, t.lineitem.count())


# -- sinks ------------------------------------------------------------------------------


@plan("create_database", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    name, before = _fresh("millrace"), t.spark.catalog.currentDatabase()
    sinks.create_database(t.spark, name, scratch_path(t.spark, "database"))
    try:
        places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        sinks.convert_to_columnar(places.select("n_nationkey", "n_name", "r_name"), "places")
    finally:
        t.spark.sql(f"USE {before}")
    return t.spark.table(f"{name}.places")


@plan("convert_to_columnar", "SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem")
def _(t):
    path = scratch_path(t.spark, "staging")
    staged = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    staged.write.option("sep", "\t").csv(path)
    text = files.scan_delimited(
        t.spark, path, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_returnflag string"
    )
    return sinks.convert_to_columnar(text, _fresh("lines"), scratch_path(t.spark, "columnar"), "orc")


@plan(
    "insert_append",
    "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer",
)
def _(t):
    table, rows = _fresh("customers"), t.customer.select("c_custkey", "c_mktsegment")
    sinks.convert_to_columnar(rows, table, scratch_path(t.spark, "append"))
    sinks.insert_append(rows, table)
    return t.spark.table(table)


@plan("load_overwrite", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(t):
    table = _fresh("loaded")
    first = t.customer.selectExpr("c_custkey AS id", "c_name AS name")
    sinks.convert_to_columnar(first, table, scratch_path(t.spark, "load"))
    sinks.load_overwrite(t.supplier.selectExpr("s_suppkey AS id", "s_name AS name"), table)
    return t.spark.table(table)


@plan("drop_table", "SELECT count(*) AS kept, 0::BIGINT AS left_over FROM part")
def _(t):
    staging, final = _fresh("staging"), _fresh("final")
    copy = sinks.convert_to_columnar(t.part, staging, scratch_path(t.spark, "drop"))
    kept = sinks.convert_to_columnar(copy, final, scratch_path(t.spark, "drop"))
    sinks.drop_table(t.spark, staging)
    left = int(t.spark.catalog.tableExists(staging))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(left).cast("bigint").alias("left_over"))


@plan(
    "write_partitioned",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_orderkey)::BIGINT AS total
    FROM lineitem GROUP BY ALL
    """,
)
def _(t):
    table = _fresh("by_flag")
    sinks.write_partitioned(
        t.lineitem, table, ["l_returnflag", "l_linestatus"], scratch_path(t.spark, "partitioned")
    )
    return t.spark.table(table).groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("l_orderkey").alias("total")
    )


@plan(
    "list_partitions",
    """
    SELECT DISTINCT 'o_orderstatus=' || o_orderstatus || '/o_orderpriority=' || o_orderpriority AS partition
    FROM orders
    """,
)
def _(t):
    table = _fresh("by_status")
    sinks.write_partitioned(
        t.orders, table, ["o_orderstatus", "o_orderpriority"], scratch_path(t.spark, "partitioned")
    )
    return sinks.list_partitions(t.spark, table)


@plan(
    "write_bucketed",
    """
    SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS lines
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
    """,
)
def _(t):
    lines, orders = _fresh("lines"), _fresh("orders")
    buckets = sinks.bucket_count(t.lineitem.select("l_orderkey", "l_partkey"))
    sinks.write_bucketed(
        t.lineitem.select("l_orderkey", "l_partkey"), lines, buckets, ["l_orderkey"], ["l_orderkey"],
        scratch_path(t.spark, "bucketed"),
    )
    sinks.write_bucketed(
        t.orders.select("o_orderkey", "o_orderstatus"), orders, buckets, ["o_orderkey"], ["o_orderkey"],
        scratch_path(t.spark, "bucketed"),
    )
    # Both tables are laid out by the join key, so neither side is shuffled.
    counted = t.spark.table(lines).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = t.spark.table(orders).join(counted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("lines"))


@plan("write_job_output", "SELECT event_type AS key, count(*)::VARCHAR AS value FROM events GROUP BY event_type")
def _(t):
    path = scratch_path(t.spark, "output")
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    sinks.write_job_output(counts, path)
    return files.scan_delimited(t.spark, path, "key string, value string")


@plan(
    "create_view",
    "SELECT o_orderstatus, count(*) AS cnt FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
)
def _(t):
    base, view = _fresh("orders"), _fresh("large_orders")
    t.orders.createOrReplaceTempView(base)
    return sinks.create_view(
        t.spark, view,
        f"SELECT o_orderstatus, count(*) AS cnt FROM {base} WHERE o_totalprice > 100000 GROUP BY o_orderstatus",
    )
