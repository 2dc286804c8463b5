"""Joins, graph steps, nested documents and lineage on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph, joins, lineage, nested
from millrace.operators.keys import spread
from millrace.plans.registry import plan
from millrace.scratch import persist_table

RATINGS_SQL = """
    ratings AS (
      SELECT o_custkey AS user, l_partkey AS item, avg(l_quantity) AS rating
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    predictions AS (SELECT user, avg(rating) AS prediction FROM ratings GROUP BY user)
"""


def ratings(t):
    """Mean quantity per customer and part as ``user, item, rating``."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return (
        lines.join(owners, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(F.avg("l_quantity").alias("rating"))
    )


def actual_predicted(t):
    """Ratings next to the mean rating of their user, keyed by floats.

    The ratings feed three steps, so they are written once instead of being joined thrice.
    """
    actual = persist_table(ratings(t), "ratings")
    mean = actual.groupBy("user", spread(["user"])).agg(F.avg("rating").alias("prediction")).drop("__spread")
    predicted = actual.select("user", "item").join(mean, "user")
    predicted = predicted.select(
        F.col("user").cast("double"), F.col("item").cast("double"), "prediction"
    )
    return joins.join_actual_predicted(actual, predicted)


@plan(
    "join_actual_predicted",
    f"""
    WITH {RATINGS_SQL}
    SELECT user::BIGINT AS user, item::BIGINT AS item, round(rating, 4) AS rating,
           round(prediction, 4) AS prediction
    FROM ratings JOIN predictions USING (user)
    """,
)
def _(t):
    return actual_predicted(t).select(
        "user", "item", F.round("rating", 4).alias("rating"), F.round("prediction", 4).alias("prediction")
    )


CLUSTERS_SQL = """
    SELECT 'sa-' || (o_orderkey + 10) AS uuid, o_orderpriority AS base FROM orders
"""


def snapshots(t):
    return t.lineitem.select(
        F.concat_ws("-", F.lit("sn"), "l_orderkey", "l_partkey", "l_linenumber").alias("snapshot_uuid"),
        F.concat(F.lit("sa-"), "l_orderkey").alias("cluster_uuid"),
        F.col("l_shipdate").alias("snapshot_ts"),
    )


def clusters(t):
    # Shifted, so that some snapshots have no cluster and some clusters no snapshot.
    return t.orders.select(
        F.concat(F.lit("sa-"), F.col("o_orderkey") + 10).alias("uuid"), F.col("o_orderpriority").alias("base")
    )


@plan(
    "snapshots_with_base",
    f"""
    SELECT 'sn-' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS uuid, base,
           strftime(l_shipdate, '%m/%w/%Y (%I:%M %p)') AS snapshot_ts
    FROM lineitem JOIN ({CLUSTERS_SQL}) ON uuid = 'sa-' || l_orderkey
    """,
)
def _(t):
    return joins.snapshots_with_base(snapshots(t), clusters(t))


@plan(
    "stacks_with_snapshot_time",
    """
    SELECT o_orderkey AS uuid, o_custkey AS snapshot_uuid,
           CASE WHEN c_custkey IS NULL THEN ''
                ELSE strftime(o_orderdate, '%m/%w/%Y (%I:%M %p)') END AS ts
    FROM orders LEFT JOIN customer ON c_custkey + 10 = o_custkey
    """,
)
def _(t):
    stacks = t.orders.select(
        F.col("o_orderkey").alias("uuid"),
        F.col("o_custkey").alias("snapshot_uuid"),
        F.col("o_orderdate").alias("ts"),
    )
    known = t.customer.select((F.col("c_custkey") + 10).alias("snapshot_uuid"))
    return joins.stacks_with_snapshot_time(stacks, known)


_INSTANCE = """
    CASE WHEN p_size < 10 THEN 't2.small' WHEN p_size < 20 THEN 'm3.xlarge'
         WHEN p_size < 30 THEN 'c3.8xlarge' WHEN p_size < 40 THEN 'r3.large' ELSE p_brand END
"""


@plan(
    "lookup_with_default",
    f"""
    WITH p AS (SELECT p_partkey, {_INSTANCE} AS instance_type FROM part)
    SELECT p_partkey, instance_type,
      CASE instance_type WHEN 't2.small' THEN 2048 WHEN 'm3.xlarge' THEN 15360
        WHEN 'c3.8xlarge' THEN 61440 WHEN 'r3.large' THEN 15616 ELSE 1024 END AS mem_mb,
      CASE instance_type WHEN 't2.small' THEN 1 WHEN 'm3.xlarge' THEN 4
        WHEN 'c3.8xlarge' THEN 32 WHEN 'r3.large' THEN 2 ELSE 1 END AS cores
    FROM p
    """,
)
def _(t):
    parts = t.part.select("p_partkey", F.expr(_INSTANCE).alias("instance_type"))
    defaults = {"mem_mb": joins.DEFAULT_MEMORY_MB, "cores": joins.DEFAULT_CORES}
    return joins.lookup_with_default(
        parts, joins.instance_dimension(t.spark), "instance_type", defaults
    )


@plan(
    "lookup_nation_with_default",
    """
    SELECT c_custkey, c_nationkey, coalesce(n_name, 'Unknown') AS n_name
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5
    """,
)
def _(t):
    nations = t.nation.select((F.col("n_nationkey") + 5).alias("c_nationkey"), "n_name")
    return joins.lookup_with_default(
        t.customer.select("c_custkey", "c_nationkey"), nations, "c_nationkey", {"n_name": "Unknown"}
    )


VERTICES_SQL = """
    vertices AS (
      SELECT o_orderkey * 2 AS _id, o_orderpriority AS name, 'order' AS type FROM orders
      UNION ALL SELECT p_partkey * 2 + 1, p_name, 'part' FROM part),
    edges AS (
      SELECT l_orderkey * 2 AS _outV, l_partkey * 2 + 1 AS _inV,
             CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'bought' END AS _label
      FROM lineitem)
"""


def vertices(t):
    """Orders and parts as vertices of one graph."""
    orders = t.orders.select(
        (F.col("o_orderkey") * 2).alias("_id"),
        F.col("o_orderpriority").alias("name"),
        F.lit("order").alias("type"),
    )
    parts = t.part.select(
        (F.col("p_partkey") * 2 + 1).alias("_id"), F.col("p_name").alias("name"), F.lit("part").alias("type")
    )
    return orders.unionByName(parts)


def edges(t):
    """Order lines as edges from their order to their part."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 2).alias("_outV"),
        (F.col("l_partkey") * 2 + 1).alias("_inV"),
        F.when(F.col("l_returnflag") == "R", "returned").otherwise("bought").alias("_label"),
    )


@plan(
    "traverse_out",
    f"""
    WITH {VERTICES_SQL}
    SELECT v._id, w.name FROM vertices v JOIN edges e ON v._id = e._outV
    JOIN vertices w ON w._id = e._inV WHERE v.name = '1-URGENT' AND e._label = 'returned'
    """,
)
def _(t):
    return graph.traverse_out(vertices(t), edges(t), F.col("name") == "1-URGENT", "returned", "name")


@plan(
    "in_degree",
    f"""
    WITH {VERTICES_SQL}
    SELECT _id, count(_inV) AS degree FROM vertices LEFT JOIN edges ON _id = _inV GROUP BY _id
    """,
)
def _(t):
    return graph.in_degree(vertices(t), edges(t))


@plan("out_ids", f"WITH {VERTICES_SQL} SELECT _inV FROM edges WHERE _outV = 24")
def _(t):
    return graph.out_ids(edges(t), 24)


@plan(
    "required_installed",
    "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def _(t):
    return joins.required_installed(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id")


@plan(
    "missing_items",
    "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(t):
    return joins.missing_items(t.documents, t.labels, "doc_id")


@plan(
    "path_prefix_join",
    r"""
    WITH p AS (SELECT DISTINCT regexp_replace(url, '[^/]*$', '') AS dir FROM pages
               UNION SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') FROM pages),
    ps AS (SELECT dir, string_split(dir, '/') AS a FROM p),
    c AS (SELECT page_id, string_split(url, '/') AS b FROM pages)
    SELECT dir, page_id FROM ps JOIN c ON len(a) <= len(b)
      AND list_bool_and(list_transform(range(1, len(a) + 1), lambda i: a[i] = '' OR a[i] = b[i]))
    """,
)
def _(t):
    with_slash = t.pages.select(F.regexp_replace("url", "[^/]*$", "").alias("dir"))
    without = t.pages.select(F.regexp_replace("url", "/[^/]*$", "").alias("dir"))
    parents = with_slash.union(without).distinct()
    pairs = joins.path_prefix_join(parents, t.pages.select("page_id", "url"), "dir", "url")
    return pairs.select("dir", "page_id")


@plan(
    "reverse_lookup",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '/logs'
      WHEN c_name LIKE '%7' THEN '/data' WHEN c_nationkey = 3 THEN '/tmp' END AS source
    FROM customer
    """,
)
def _(t):
    rows = t.customer.select(
        "c_custkey",
        F.create_map(
            F.lit("/logs"), F.col("c_mktsegment"),
            F.lit("/data"), F.when(F.col("c_name").like("%7"), "BUILDING").otherwise("-"),
            F.lit("/tmp"), F.when(F.col("c_nationkey") == 3, "BUILDING").otherwise("-"),
        ).alias("volumes"),
        F.lit("BUILDING").alias("target"),
    )
    return nested.find_mount(rows, "volumes", "target").select("c_custkey", "source")


@plan(
    "nest_children",
    """
    WITH c AS (SELECT c_custkey::VARCHAR AS uuid, c_name AS entry, c_mktsegment AS uniq FROM customer),
    refs AS (
      SELECT o_orderkey, 'connectors' AS cls, 0 AS pos, o_custkey::VARCHAR AS uuid FROM orders
      UNION ALL SELECT o_orderkey, 'storage', 0, (o_custkey + 1)::VARCHAR FROM orders
      UNION ALL SELECT o_orderkey, 'compute', 0, (o_custkey + 2)::VARCHAR FROM orders
                WHERE o_orderstatus <> 'P'
      UNION ALL SELECT o_orderkey, 'compute', 1, o_custkey::VARCHAR FROM orders
                WHERE o_orderstatus <> 'P'),
    shown AS (
      SELECT o_orderkey, cls, pos,
             refs.uuid || ':' || coalesce(entry, '-') || ':' || coalesce(uniq, '-') AS item
      FROM refs LEFT JOIN c ON refs.uuid = c.uuid)
    SELECT o.o_orderkey AS uuid,
      coalesce(string_agg(item, ',' ORDER BY pos) FILTER (cls = 'connectors'), '') AS connectors,
      coalesce(string_agg(item, ',' ORDER BY pos) FILTER (cls = 'storage'), '') AS storage,
      coalesce(string_agg(item, ',' ORDER BY pos) FILTER (cls = 'compute'), '') AS compute
    FROM orders o LEFT JOIN shown USING (o_orderkey) GROUP BY o.o_orderkey
    """,
)
def _(t):
    customer = F.col("o_custkey")
    compute = F.when(
        F.col("o_orderstatus") != "P",
        F.array((customer + 2).cast("string"), customer.cast("string")),
    )
    backend = F.struct((customer + 1).cast("string").alias("storage"), compute.alias("compute"))
    stacks = t.orders.select(
        F.col("o_orderkey").alias("uuid"),
        F.array(customer.cast("string")).alias("connectors"),
        F.struct(F.array(backend).alias("uuids")).alias("backends"),
    )
    services = t.customer.select(
        F.col("c_custkey").cast("string").alias("child"),
        F.col("c_name").alias("entry"),
        F.col("c_mktsegment").alias("uniq"),
    )
    classes = {c: c for c in ("connectors", "storage", "compute")}
    flat = nested.backend_uuids(stacks).drop("backends")
    docs = nested.nest_children(flat, services, "uuid", classes, "child")

    def shown(col):
        return F.array_join(
            F.transform(
                col,
                lambda r: F.concat_ws(
                    ":", r["child"], F.coalesce(r["entry"], F.lit("-")), F.coalesce(r["uniq"], F.lit("-"))
                ),
            ),
            ",",
        )

    return docs.select("uuid", *[shown(c).alias(c) for c in classes])


LINEAGE_EDGES_SQL = """
    edges AS (
      SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS base FROM customer
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 'p' || p_partkey, 'p' || (p_partkey // 2) FROM part WHERE p_partkey > 0)
"""

LINEAGE_SQL = f"""
    WITH RECURSIVE {LINEAGE_EDGES_SQL},
    l AS (
      SELECT child, base AS ancestor, 1 AS depth FROM edges
      UNION ALL SELECT l.child, e.base, l.depth + 1 FROM l JOIN edges e ON e.child = l.ancestor)
"""


def lineage_edges(t):
    customers = t.customer.select(
        F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("base")
    )
    nations = t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("base")
    )
    parts = t.part.filter("p_partkey > 0").select(
        F.concat(F.lit("p"), "p_partkey").alias("child"),
        F.concat(F.lit("p"), F.expr("p_partkey div 2")).alias("base"),
    )
    return customers.unionByName(nations).unionByName(parts)


@plan("base_lineage", f"{LINEAGE_SQL} SELECT child, ancestor, depth FROM l")
def _(t):
    return lineage.base_lineage(lineage_edges(t))


@plan(
    "build_order",
    f"""
    {LINEAGE_SQL}
    SELECT child AS name, max(depth) AS step FROM l GROUP BY child
    UNION ALL
    SELECT DISTINCT base, 0 FROM edges WHERE base NOT IN (SELECT child FROM edges)
    """,
)
def _(t):
    return lineage.build_order(lineage_edges(t))


def deep(value, levels):
    """A value below ``levels`` objects, each with the one key ``l``."""
    for _ in range(levels):
        value = F.struct(value.alias("l"))
    return value


def config_documents(t):
    """A default document per customer and an override per customer with orders."""
    left = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.to_json(
            F.struct(
                F.col("c_mktsegment").alias("a"),
                F.struct(F.col("c_name").alias("c"), F.col("c_nationkey").alias("d")).alias("b"),
                F.struct(F.lit("x").alias("f"), F.struct(F.lit("y").alias("h")).alias("g")).alias("e"),
                deep(F.col("c_name"), 12).alias("z"),
            )
        ).alias("doc"),
    )
    top = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_orderpriority").alias("p"), F.max("o_orderkey").alias("k")
    )
    right = top.select(
        "id",
        F.to_json(
            F.struct(
                F.struct(F.col("p").alias("c")).alias("b"),
                F.when(F.col("p") == "5-LOW", F.col("k")).alias("e"),
                F.col("p").alias("n"),
            )
        ).alias("doc"),
    )
    return left, right


@plan(
    "merge_config",
    """
    WITH o AS (SELECT o_custkey AS id, max(o_orderpriority) AS p, max(o_orderkey) AS k
               FROM orders GROUP BY o_custkey),
    c AS (SELECT c_custkey AS id, c_mktsegment, c_name, c_nationkey, p, k
          FROM customer LEFT JOIN o ON c_custkey = id)
    SELECT id, 'a' AS path, c_mktsegment AS value FROM c
    UNION ALL SELECT id, 'b.c', coalesce(p, c_name) FROM c
    UNION ALL SELECT id, 'b.d', c_nationkey::VARCHAR FROM c
    UNION ALL SELECT id, 'e', k::VARCHAR FROM c WHERE p = '5-LOW'
    UNION ALL SELECT id, 'e.f', 'x' FROM c WHERE p IS NULL OR p <> '5-LOW'
    UNION ALL SELECT id, 'e.g.h', 'y' FROM c WHERE p IS NULL OR p <> '5-LOW'
    UNION ALL SELECT id, 'n', p FROM c WHERE p IS NOT NULL
    UNION ALL SELECT id, 'z' || repeat('.l', 12), c_name FROM c
    """,
)
def _(t):
    left, right = (
        nested.json_leaves(d, "id", "doc").withColumn("value", F.col("value").cast("string"))
        for d in config_documents(t)
    )
    merged = nested.merge_config(left, right, "id")
    return merged.select("id", F.array_join("path", ".").alias("path"), "value")


_STORAGE = """
    CASE o_orderpriority WHEN '1-URGENT' THEN 'hadoop' WHEN '2-HIGH' THEN 'cassandra'
      WHEN '3-MEDIUM' THEN 'spark' WHEN '5-LOW' THEN 'titan' ELSE 'unknown' END
"""
_COMPUTE = "CASE o_orderstatus WHEN 'F' THEN 'hive' WHEN 'O' THEN 'mongodb' ELSE 'yarn' END"


@plan(
    "client_services_for_backends",
    f"""
    WITH m(type, client) AS (VALUES ('openmpi', 'mpi-client'), ('yarn', 'hadoop-client'),
      ('spark', 'spark-client'), ('gluster', 'mpi-client'), ('cassandra', 'cassandra-client'),
      ('titan', 'cassandra-client'), ('hadoop', 'hadoop-client'), ('hive', 'hadoop-client'),
      ('mongodb', 'mongo-client')),
    b AS (SELECT o_orderkey, {_STORAGE} AS storage, {_COMPUTE} AS compute FROM orders),
    r AS (SELECT o_orderkey, 1 AS pos, storage AS type FROM b
          UNION ALL SELECT o_orderkey, 2, compute FROM b
          UNION ALL SELECT o_orderkey, 3, compute FROM b)
    SELECT o_orderkey, string_agg(type, ',' ORDER BY pos) AS service_names,
           string_agg(DISTINCT client, ',' ORDER BY client) AS client_services
    FROM r JOIN m USING (type) GROUP BY o_orderkey
    """,
)
def _(t):
    typed = t.orders.select("o_orderkey", F.expr(_STORAGE).alias("s"), F.expr(_COMPUTE).alias("c"))
    stacks = typed.select("o_orderkey", F.array("s", "c", "c").alias("types"))
    found = joins.client_services_for_backends(stacks, "types")
    return found.select(
        "o_orderkey",
        F.array_join("service_names", ",").alias("service_names"),
        F.array_join("client_services", ",").alias("client_services"),
    )


@plan(
    "flatten_to_pairs",
    """
    SELECT c_custkey, 'P_TYPE' AS name, c_mktsegment AS value FROM customer
    UNION ALL SELECT c_custkey, 'P_NAME', c_name FROM customer
    UNION ALL SELECT c_custkey, 'P' || repeat('_LAYER', 11) || '_L', c_name FROM customer
    UNION ALL SELECT c_custkey, 'P_LAYER_NATION', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT c_custkey, 'P_LAYER_LAYER_REGION', r_name FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    whole = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.struct(F.col("r_name").alias("region"), F.col("r_regionkey").alias("rank"))
    layer = F.struct(F.col("n_name").alias("nation"), F.col("n_nationkey").alias("key"), region.alias("place"))
    first = F.struct(
        F.lit("earlier").alias("type"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.array(F.col("c_name")).alias("list"),
        layer.alias("layer"),
        deep(F.col("c_name"), 11).alias("deep"),
    )
    docs = whole.select(
        "c_custkey",
        F.concat(
            F.lit("["), F.to_json(first), F.lit(","),
            F.to_json(F.struct(F.col("c_mktsegment").alias("type"))), F.lit("]"),
        ).alias("doc"),
    )
    return nested.flatten_to_pairs(docs, "c_custkey", "doc", "P")
