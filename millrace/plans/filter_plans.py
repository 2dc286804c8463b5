"""Filters and projections on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import filters, projections
from millrace.plans.registry import plan


@plan("filter_range_count", "SELECT count(user_id) AS cnt FROM events WHERE user_id < 10")
def _(t):
    return filters.filter_range_count(t.events, "user_id", 10)


@plan("lookup_by_secondary_key", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return filters.lookup_by_secondary_key(t.customer, "c_mktsegment", "BUILDING")


@plan(
    "lines_containing",
    """
    SELECT count(*) FILTER (contains(line, 'a')) AS lines_with_a,
           count(*) FILTER (contains(line, 'b')) AS lines_with_b
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    """,
)
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return filters.lines_containing(lines, {"lines_with_a": "a", "lines_with_b": "b"})


@plan(
    "filter_by_property",
    "SELECT p_partkey AS _id, p_name AS name, p_type AS type FROM part WHERE p_name = 'red widget'",
)
def _(t):
    vertices = t.part.select(
        F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")
    )
    return filters.filter_by_property(vertices, "name", "red widget")


@plan(
    "filter_by_constraints",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
    """,
)
def _(t):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return filters.filter_by_constraints(t.orders, wanted).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


_MESSAGE = """
    CASE event_type
      WHEN 'error' THEN 'ssh:' || chr(10) || 'No route to host' || chr(10)
      WHEN 'click' THEN 'Connection refused by peer'
      WHEN 'purchase' THEN 'Connection closed by ' || user_id
      WHEN 'signup' THEN CASE WHEN value < 10 THEN 'timed ou' ELSE 'Permission denied (publickey)' END
      ELSE 'exit status ' || user_id
    END
"""


@plan(
    "classify_messages",
    f"""
    WITH m AS (SELECT event_id, {_MESSAGE} AS message FROM events),
    c AS (
      SELECT event_id, CASE
        WHEN contains(message, 'No route to host') THEN 'no_route'
        WHEN contains(message, 'Connection closed') THEN 'closed'
        WHEN contains(message, 'Connection refused') THEN 'refused'
        WHEN contains(message, 'timed ou') THEN 'timed_out'
        WHEN contains(message, 'Permission denied') THEN 'denied'
        ELSE 'other' END AS reason
      FROM m)
    SELECT event_id, reason, reason <> 'other' AS retryable FROM c
    """,
)
def _(t):
    messages = t.events.select("event_id", F.expr(_MESSAGE).alias("message"))
    return filters.classify_messages(messages, "message").drop("message")


_IMAGE = """
    CASE WHEN p_size < 10 THEN '<none>'
         WHEN p_type = 'ECONOMY' THEN ' REPOSITORY '
         WHEN p_type = 'PROMO' THEN '   '
         ELSE '  ' || p_name || ' ' END
"""


@plan(
    "exclude_sentinels",
    f"""
    SELECT p_partkey, trim(image) AS image FROM (SELECT p_partkey, {_IMAGE} AS image FROM part)
    WHERE trim(image) NOT IN ('REPOSITORY', '<none>', '')
    """,
)
def _(t):
    images = t.part.select("p_partkey", F.expr(_IMAGE).alias("image"))
    return filters.exclude_sentinels(images, "image")


@plan(
    "exists_where",
    "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 5 AND o_orderstatus = 'P'",
)
def _(t):
    return filters.exists_where(t.orders, {"o_orderkey": 5}, {"o_orderstatus": "P"})


@plan("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return projections.drop_columns(t.customer, ["c_name"])


@plan("select_fields", "SELECT p_partkey, p_name, p_size FROM part")
def _(t):
    return projections.select_fields(t.part, ["p_size", "p_name", "p_partkey"])


@plan(
    "derive_sizing",
    """
    WITH s AS (
      SELECT p_partkey, greatest(p_size * 200, 1024)::BIGINT AS total_mb, p_size::BIGINT AS cores,
             (p_size + 2)::BIGINT AS nodes FROM part),
    m AS (SELECT *, greatest(total_mb // 8, 512) AS task_mb FROM s)
    SELECT p_partkey, total_mb, task_mb, task_mb * 2 AS reduce_mb,
           '-Xmx' || floor(task_mb::DOUBLE * 0.8::DOUBLE)::BIGINT || 'm' AS task_heap,
           '-Xmx' || floor((task_mb * 2)::DOUBLE * 0.8::DOUBLE)::BIGINT || 'm' AS reduce_heap,
           greatest(cores // 2, 1) AS node_cores, greatest(cores, 1) * 4 AS node_maps,
           greatest(cores, 1) * 4 * (nodes - 2) AS job_maps,
           greatest(cores, 1) * (nodes - 2) AS job_reduces
    FROM m
    """,
)
def _(t):
    rows = t.part.select(
        "p_partkey",
        (F.col("p_size") * 200).alias("mem"),
        F.col("p_size").alias("cores"),
        (F.col("p_size") + 2).alias("nodes"),
    )
    return projections.derive_sizing(rows, "mem", "cores", "nodes").drop("mem", "cores", "nodes")


@plan(
    "fill_defaults",
    """
    SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'Unknown') AS author,
           coalesce(nullif(p_size, 1), 0) AS size,
           CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS tags
    FROM part
    """,
)
def _(t):
    rows = t.part.select(
        "p_partkey",
        F.expr("nullif(p_type, 'ECONOMY')").alias("author"),
        F.expr("nullif(p_size, 1)").alias("size"),
        F.when(F.col("p_size") > 25, F.array("p_brand")).alias("tags"),
    )
    filled = projections.fill_defaults(rows, {"author": "Unknown", "size": 0, "tags": []})
    return filled.withColumn("tags", F.array_join("tags", ","))


@plan("truncate_description", "SELECT doc_id, left(text, 21) || '...' AS short FROM documents")
def _(t):
    return projections.truncate_description(t.documents, "text").select("doc_id", "short")


@plan(
    "zip_columns",
    """
    SELECT c_custkey, c_name, balance FROM
      (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
      JOIN (SELECT c_acctbal AS balance, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn
            FROM customer) USING (rn)
    """,
)
def _(t):
    names = t.customer.select("c_custkey", "c_name")
    balances = t.customer.select(F.col("c_custkey").alias("tie"), F.col("c_acctbal").alias("balance"))
    zipped = projections.zip_columns(names, balances, ["c_custkey"], ["balance", "tie"], unique=True)
    return zipped.drop("tie")


@plan(
    "substitute_template",
    """
    SELECT c_custkey, c_name || ' of ' || c_nationkey || ' pays $5 for ' || c_mktsegment
           || ' x{unknown}' AS text
    FROM customer
    """,
)
def _(t):
    rows = t.customer.withColumn(
        "template", F.lit("$NAME of ${NATION} pays $$5 for {segment} x{unknown}")
    )
    params = F.create_map(
        F.lit("NAME"), F.col("c_name"),
        F.lit("NATION"), F.col("c_nationkey").cast("string"),
        F.lit("segment"), F.col("c_mktsegment"),
    )
    return projections.substitute_template(rows, "template", params, "text").select(
        "c_custkey", "text"
    )


@plan(
    "expand_instances",
    """
    WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_size >= 5 THEN p_size // 8 ELSE 1 END AS n FROM part)
    SELECT p_partkey, i::BIGINT AS instance,
           CASE WHEN n > 1 THEN p_name || '-' || i ELSE p_name END AS p_name,
           (n + 2 + CASE WHEN n > 3 THEN 1 ELSE 0 END)::BIGINT AS containers
    FROM (SELECT *, unnest(range(n)) AS i FROM s)
    """,
)
def _(t):
    rows = t.part.select(
        "p_partkey", "p_name", F.expr("CASE WHEN p_size >= 5 THEN cast(p_size div 8 AS int) END").alias("n")
    )
    expanded = projections.expand_instances(rows, "n", "p_name")
    layers = F.when(F.col("n") > 3, F.array(F.lit("hive")))
    containers = projections.cluster_instances(F.col("n"), layers).cast("bigint")
    return expanded.withColumn("containers", containers).drop("n")


@plan(
    "assign_roles",
    """
    SELECT o_custkey, o_orderkey, CASE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
           WHEN 1 THEN 'compute_master' WHEN 2 THEN 'storage_master' ELSE 'worker' END AS role
    FROM orders
    """,
)
def _(t):
    rows = t.orders.select("o_custkey", "o_orderkey")
    return projections.assign_roles(rows, ["o_custkey"], ["o_orderkey"])


@plan(
    "require_all_keys",
    """
    SELECT c_custkey,
      CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey <> 3 THEN c_mktsegment END AS account,
      CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey <> 3 THEN c_name END AS server
    FROM customer
    """,
)
def _(t):
    rows = t.customer.select(
        "c_custkey",
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("account"),
        F.expr("CASE WHEN c_nationkey <> 3 THEN c_name END").alias("server"),
    )
    return projections.require_all_keys(rows, ["account", "server"])


@plan(
    "assign_short_ids",
    """
    WITH i AS (SELECT o_orderkey, 'sa-' || left(sha256(o_orderkey::VARCHAR), 8) AS id FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS rn FROM i)
    SELECT o_orderkey, CASE WHEN rn > 1 THEN id || '-' || rn ELSE id END AS short_id FROM n
    """,
)
def _(t):
    return projections.assign_short_ids(t.orders.select("o_orderkey"), "o_orderkey", "stack")
