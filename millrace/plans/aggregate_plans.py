"""Aggregations, profiles, sorting, set operations and table changes on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import aggregates, graph, mutations, ordering, profile, sets, table_changes
from millrace.operators.keys import deal_rows, spread
from millrace.operators.numbering import positions
from millrace.plans.join_plans import (
    RATINGS_SQL,
    VERTICES_SQL,
    actual_predicted,
    edges,
    vertices,
)
from millrace.plans.registry import plan
from millrace.scratch import persist_table, scratch_path
from millrace.sources import sinks
from millrace.sources.generated import rows_literal

# -- aggregations -----------------------------------------------------------------------


@plan(
    "count_by_key",
    """
    SELECT CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
           count(CASE WHEN event_type = 'error' THEN NULL ELSE user_id END) AS cnt
    FROM events GROUP BY 1
    """,
)
def _(t):
    known = F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id")
    return aggregates.count_by_key(t.events.select(known), "user_id")


_TOKENS = r"""
    SELECT word FROM (
      SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
    WHERE word <> ''
"""


@plan("word_count", f"SELECT word, count(*) AS cnt FROM ({_TOKENS}) GROUP BY word")
def _(t):
    return aggregates.word_count(t.documents, "text")


@plan(
    "word_mean",
    f"SELECT round(sum(length(word)) / count(*), 6) AS mean_length FROM ({_TOKENS})",
)
def _(t):
    mean = aggregates.word_mean(t.documents, "text")
    return mean.select(F.round("mean_length", 6).alias("mean_length"))


@plan(
    "word_median",
    f"SELECT quantile_disc(length(word), 0.5)::BIGINT AS median_length FROM ({_TOKENS})",
)
def _(t):
    return aggregates.word_median(t.documents, "text")


CENTRES_SQL = """
    points AS (SELECT vec_id, label, embedding::DOUBLE[] AS p FROM embeddings),
    dims AS (SELECT label, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM points),
    means AS (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i),
    centres AS (SELECT label, list(x ORDER BY i) AS centre FROM means GROUP BY label)
"""


def label_centres(t):
    """Mean vector of each label."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg("x").alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("i", "x")))
    centres = means.groupBy("label", spread(["label"])).agg(
        F.transform(listed, lambda s: s["x"]).alias("centre")
    )
    return centres.drop("__spread")


@plan(
    "sum_distance",
    f"""
    WITH {CENTRES_SQL}
    SELECT round(sum(list_distance(p, centre)), 4) AS wssse FROM points JOIN centres USING (label)
    """,
)
def _(t):
    measured = t.embeddings.join(label_centres(t), "label")
    return aggregates.sum_distance(measured, "embedding", "centre").select(
        F.round("wssse", 4).alias("wssse")
    )


@plan(
    "mean_squared_error",
    f"""
    WITH {RATINGS_SQL}
    SELECT round(avg((rating - prediction) ** 2), 4) AS mse FROM ratings JOIN predictions USING (user)
    """,
)
def _(t):
    return aggregates.mean_squared_error(actual_predicted(t), "rating", "prediction").select(
        F.round("mse", 4).alias("mse")
    )


@plan(
    "training_error",
    """
    SELECT round(avg(CASE WHEN quality <> (n_chars > 1000)::INTEGER THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)
      AS error
    FROM labels JOIN documents USING (doc_id)
    """,
)
def _(t):
    judged = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn(
        "predicted", (F.col("n_chars") > 1000).cast("int")
    )
    return aggregates.training_error(judged, "quality", "predicted").select(
        F.round("error", 6).alias("error")
    )


@plan("distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return aggregates.distinct_values(t.part, "p_brand")


@plan(
    "degree_histogram",
    f"""
    WITH {VERTICES_SQL},
    d AS (SELECT _id, count(_inV) AS degree FROM vertices LEFT JOIN edges ON _id = _inV GROUP BY _id)
    SELECT degree, count(*) AS vertices FROM d GROUP BY degree
    """,
)
def _(t):
    return aggregates.degree_histogram(graph.in_degree(vertices(t), edges(t)))


@plan("shape", "SELECT count(*) AS rowcount, 6::BIGINT AS colcount FROM orders")
def _(t):
    return aggregates.shape(t.orders)


@plan(
    "column_widths",
    """
    SELECT greatest(max(length(p_partkey::VARCHAR)), 9)::INTEGER AS p_partkey,
           greatest(max(least(length(p_name), 8)), 6)::INTEGER AS p_name,
           greatest(max(greatest(length(p_brand), 12)), 7)::INTEGER AS p_brand,
           greatest(max(length(p_type)), 6)::INTEGER AS p_type
    FROM part
    """,
)
def _(t):
    shown = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    return aggregates.column_widths(shown, {"p_brand": 12}, {"p_name": 8})


@plan(
    "outputs_by_host",
    """
    SELECT user_id AS host, max_by(trim(output), event_id) AS output FROM (
      SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN '   '
             ELSE '  ' || event_type || ':' || event_id || ' ' END AS output FROM events)
    WHERE trim(output) <> '' GROUP BY user_id
    """,
)
def _(t):
    said = t.events.select(
        F.col("user_id").alias("host"),
        "event_id",
        F.when(F.col("event_type") == "view", "   ")
        .otherwise(F.concat(F.lit("  "), "event_type", F.lit(":"), "event_id", F.lit(" ")))
        .alias("output"),
    )
    return aggregates.outputs_by_host(said, "host", "output", "event_id")


@plan(
    "reduce_sum_count",
    """
    SELECT sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total, count(*) AS cnt FROM lineitem
    """,
)
def _(t):
    prices = t.lineitem.select(F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return aggregates.reduce_sum_count(prices, "price").withColumn(
        "total", F.col("total").cast("double")
    )


# -- profiles ---------------------------------------------------------------------------

_NULLS = "NULL::VARCHAR AS decimal_low, NULL::VARCHAR AS decimal_high"


def _stats_sql(table: str, column: str, kind: str, by: str = "") -> str:
    """Profile row of one column in SQL; ``kind`` is the declared type."""
    low_high = {"long": ("NULL::BIGINT", "NULL::BIGINT"), "double": ("NULL::DOUBLE", "NULL::DOUBLE")}
    avg_len, max_len = "NULL::DOUBLE", "NULL::BIGINT"
    if kind in ("bigint", "int"):
        low_high["long"] = (f"min({column})::BIGINT", f"max({column})::BIGINT")
    elif kind == "double":
        low_high["double"] = (f"min({column})", f"max({column})")
    elif kind == "timestamp_ntz":
        low_high["long"] = (
            f"floor(epoch(min({column})))::BIGINT",
            f"floor(epoch(max({column})))::BIGINT",
        )
    else:
        avg_len, max_len = f"round(avg(length({column})), 6)", f"max(length({column}))::BIGINT"
    return f"""
        SELECT {by + ',' if by else ''} '{column}' AS column_name, '{kind}' AS column_type,
          {low_high['long'][0]} AS long_low, {low_high['long'][1]} AS long_high,
          {low_high['double'][0]} AS double_low, {low_high['double'][1]} AS double_high, {_NULLS},
          count(*) FILTER ({column} IS NULL) AS num_nulls, count(DISTINCT {column}) AS num_distincts,
          {avg_len} AS avg_length, {max_len} AS max_length,
          NULL::BIGINT AS num_trues, NULL::BIGINT AS num_falses
        FROM {table} {'GROUP BY ' + by if by else ''}
    """


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
             ("c_acctbal", "double"), ("c_mktsegment", "string")]
_LINES = [("l_suppkey", "bigint"), ("l_quantity", "double"), ("l_linestatus", "string"),
          ("l_shipdate", "timestamp_ntz")]


@plan("profile_columns", " UNION ALL ".join(_stats_sql("customer", c, k) for c, k in _CUSTOMER))
def _(t):
    return profile.profile_columns(t.customer, exact=True).withColumn(
        "avg_length", F.round("avg_length", 6)
    )


@plan(
    "profile_columns_by_partition",
    " UNION ALL ".join(_stats_sql("lineitem", c, k, "l_returnflag") for c, k in _LINES),
)
def _(t):
    lines = t.lineitem.select("l_returnflag", *[c for c, _k in _LINES])
    return profile.profile_columns(lines, ["l_returnflag"], exact=True).withColumn(
        "avg_length", F.round("avg_length", 6)
    )


@plan("profile_columns_approx")
def _(t):
    return profile.profile_columns(t.lineitem)


@plan(
    "profile_columns_estimates",
    """
    SELECT 'c_custkey' AS column_name, count(*) - count(c_custkey) AS num_nulls, true AS close FROM customer
    UNION ALL SELECT 'c_name', count(*) - count(c_name), true FROM customer
    UNION ALL SELECT 'c_nationkey', count(*) - count(c_nationkey), true FROM customer
    UNION ALL SELECT 'c_acctbal', count(*) - count(c_acctbal), true FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), true FROM customer
    """,
)
def _(t):
    """Estimated distinct counts are within 15 % of the exact ones."""
    exact = profile.profile_columns(t.customer, exact=True).select("column_name", F.col("num_distincts").alias("n"))
    guess = profile.profile_columns(t.customer).join(exact, "column_name")
    return guess.select("column_name", "num_nulls", (F.abs(F.col("num_distincts") - F.col("n")) <= 0.15 * F.col("n") + 2).alias("close"))


@plan(
    "skewed_values",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS cnt FROM lineitem
    GROUP BY l_returnflag, l_linestatus HAVING count(*) > 0.1::DOUBLE * (SELECT count(*) FROM lineitem)
    """,
)
def _(t):
    return profile.skewed_values(t.lineitem, ["l_returnflag", "l_linestatus"], 0.1)


@plan(
    "skewed_values_of_many",
    """
    SELECT l_quantity, l_returnflag, count(*) AS cnt FROM lineitem
    GROUP BY ALL HAVING count(*) > 0.0067::DOUBLE * (SELECT count(*) FROM lineitem)
    """,
)
def _(t):
    return profile.skewed_values(t.lineitem, ["l_quantity", "l_returnflag"], 0.0067)


@plan(
    "merge_statistics",
    """
    WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderdate FROM orders),
    each AS (
      SELECT 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS num_nulls, min(o_orderkey) AS long_low,
             max(o_orderkey) AS long_high, NULL::DOUBLE AS double_low, NULL::DOUBLE AS double_high,
             NULL::DOUBLE AS avg_length, NULL::BIGINT AS max_length FROM o
      UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), NULL, NULL, min(o_totalprice), max(o_totalprice), NULL, NULL FROM o
      UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), NULL, NULL, NULL, NULL,
             round(avg(length(o_orderpriority)), 6), max(length(o_orderpriority)) FROM o
      UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), floor(epoch(min(o_orderdate)))::BIGINT,
             floor(epoch(max(o_orderdate)))::BIGINT, NULL, NULL, NULL, NULL FROM o)
    SELECT *, true AS distincts_close, true AS median_close FROM each
    """,
)
def _(t):
    """Statistics by status and priority, stored; one status comes later, and all are added up."""
    orders = t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    late = F.col("o_orderstatus") == "F"
    stored = persist_table(profile.partition_statistics(orders.filter(~late), ["o_orderstatus"]), "statistics")
    new = profile.partition_statistics(orders.filter(late), ["o_orderstatus"])
    whole = profile.read_statistics(profile.merge_statistics(stored.unionByName(new)))
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"]
    numbers = ["o_orderkey", "o_totalprice"]
    distinct = F.create_map(*[x for c in columns for x in (F.lit(c), F.count_distinct(c))])
    exact = deal_rows(orders, profile.DISTINCT_ROWS).agg(distinct.alias("n")).scalar()
    near = {c: profile.exact_quantiles(orders, c, [0.45, 0.55]) for c in numbers}
    around = F.create_map(*[x for c in numbers for x in (F.lit(c), F.lit(near[c]).cast("array<double>"))])[F.col("column_name")]
    middle = F.col("quantiles")[0]
    return whole.select(
        "column_name", "num_nulls", "long_low", "long_high", "double_low", "double_high",
        F.round("avg_length", 6).alias("avg_length"), "max_length",
        (F.abs(F.col("num_distincts") / exact[F.col("column_name")] - 1) < 0.05).alias("distincts_close"),
        F.coalesce(middle.between(around[0], around[1]), F.lit(True)).alias("median_close"),
    )


# -- sorting ----------------------------------------------------------------------------


@plan(
    "sort_rows",
    """
    SELECT l_returnflag, l_discount, l_linestatus, row_number() OVER
      (ORDER BY l_discount DESC, l_returnflag DESC, l_discount DESC, l_linestatus DESC) AS rn
    FROM lineitem
    """,
)
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_discount", "l_linestatus")
    return positions(ordering.sort_rows(rows, "l_discount", reverse=True), "rn")


@plan(
    "slice_rows",
    """
    SELECT c_custkey, c_name, c_mktsegment FROM customer
    ORDER BY c_mktsegment, c_custkey LIMIT 50 OFFSET 100
    """,
)
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return ordering.slice_rows(rows, "c_mktsegment", 100, 150)


@plan(
    "slice_rows_deep",
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 3000 OFFSET 11000
    """,
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return ordering.slice_rows(rows, "o_orderpriority", 11000, 14000, reverse=True)


@plan(
    "slice_then_sort",
    """
    SELECT *, row_number() OVER (ORDER BY p_size, p_brand) AS rn FROM
      (SELECT p_brand, p_size FROM part ORDER BY p_brand, p_size LIMIT 160 OFFSET 20)
    """,
)
def _(t):
    parts = t.part.select("p_brand", "p_size")
    return positions(ordering.slice_then_sort(parts, ["p_brand"], "p_size", 20, 180), "rn")


@plan(
    "total_order_sort",
    """
    SELECT user_id AS key, event_type AS payload, row_number() OVER (ORDER BY user_id, event_type) AS rn
    FROM events
    """,
)
def _(t):
    records = t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("payload"))
    return positions(ordering.total_order_sort(records, "key"), "rn")


@plan(
    "first_n_joined",
    """
    SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_suppkey) AS s_name FROM (
      SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier)
    WHERE rn <= 6 GROUP BY s_nationkey
    """,
)
def _(t):
    return ordering.first_n_joined(t.supplier, ["s_nationkey"], "s_name", ["s_suppkey"])


@plan(
    "first_match_per_group",
    """
    SELECT o_custkey, min_by(o_orderpriority, o_orderkey) AS o_orderpriority
    FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
    """,
)
def _(t):
    return ordering.first_match_per_group(
        t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey", F.col("o_orderstatus") == "F"
    )


@plan("index_row", "SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1 OFFSET 7")
def _(t):
    return ordering.index_row(t.supplier, ["s_acctbal", "s_suppkey"], 7)


@plan(
    "sort_by_expression",
    """
    SELECT o_orderpriority, o_orderstatus, row_number() OVER
      (ORDER BY length(o_orderpriority) * -1, o_orderpriority, o_orderstatus) AS rn
    FROM orders
    """,
)
def _(t):
    rows = t.orders.select("o_orderpriority", "o_orderstatus")
    key = -F.length(F.col("o_orderpriority"))
    return positions(ordering.sort_by_expression(rows, key), "rn")


# -- set operations ---------------------------------------------------------------------


@plan(
    "union_right_precedence",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer
    WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
    """,
)
def _(t):
    left = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS bal")
    right = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS bal")
    return sets.union_right_precedence(left, right, ["id"])


@plan(
    "union_left_precedence",
    """
    SELECT c_custkey AS id, c_name AS name FROM customer
    UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)
    """,
)
def _(t):
    left = t.customer.selectExpr("c_custkey AS id", "c_name AS name")
    right = t.part.selectExpr("p_partkey AS id", "p_name AS name")
    return sets.union_left_precedence(left, right, ["id"])


@plan("intersect_names", "SELECT l_partkey AS id FROM lineitem INTERSECT SELECT c_custkey FROM customer")
def _(t):
    return sets.intersect_names(
        t.lineitem.selectExpr("l_partkey AS id"), t.customer.selectExpr("c_custkey AS id"), "id"
    )


@plan("except_names", "SELECT l_partkey AS id FROM lineitem EXCEPT SELECT c_custkey FROM customer")
def _(t):
    return sets.except_names(
        t.lineitem.selectExpr("l_partkey AS id"), t.customer.selectExpr("c_custkey AS id"), "id"
    )


@plan(
    "append_rows_checked",
    """
    SELECT c_custkey AS "Field 1", c_name AS "Field 2" FROM customer
    UNION ALL SELECT s_suppkey, s_name FROM supplier
    """,
)
def _(t):
    rows = sets.append_rows_checked(
        t.customer.select("c_custkey", "c_name"), t.supplier.select("s_suppkey", "s_name")
    )
    return sets.auto_field_names(rows)


# -- table changes ----------------------------------------------------------------------


@plan(
    "rows_literal",
    """
    SELECT c_custkey AS user_id, c_name AS fname, c_mktsegment AS lname FROM customer
    WHERE c_custkey NOT IN (1744, 1745, 1746)
    UNION ALL VALUES (1745, 'john', 'smith'), (1744, 'john', 'doe'), (1746, 'john', 'smith')
    """,
)
def _(t):
    users = t.customer.selectExpr("c_custkey AS user_id", "c_name AS fname", "c_mktsegment AS lname")
    added = rows_literal(
        t.spark,
        [(1745, "john", "smith"), (1744, "john", "doe"), (1746, "john", "smith")],
        "user_id bigint, fname string, lname string",
    )
    return mutations.replace_rows(users, added, ["user_id"])


@plan(
    "upsert_by_key",
    """
    WITH c AS (SELECT o_custkey AS id, 'order ' || o_orderkey AS name, o_totalprice AS bal,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders)
    SELECT id, name, bal FROM c WHERE rn = 1
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM c)
    """,
)
def _(t):
    base = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS bal")
    changes = t.orders.selectExpr(
        "o_custkey AS id", "'order ' || o_orderkey AS name", "o_totalprice AS bal",
        "o_orderdate", "o_orderkey",
    )
    return mutations.upsert_by_key(base, changes, ["id"], ["o_orderdate", "o_orderkey"])


@plan(
    "set_fields",
    """
    WITH c AS (SELECT o_custkey AS id,
        max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS segment,
        count(*) FILTER (o_orderstatus = 'F') AS has_segment,
        max_by(CASE o_orderstatus WHEN 'O' THEN o_totalprice ELSE -1 END, o_orderkey)
          FILTER (o_orderstatus <> 'F') AS bal,
        count(*) FILTER (o_orderstatus <> 'F') AS has_bal
      FROM orders GROUP BY o_custkey),
    b AS (SELECT s_suppkey AS id, s_name AS name, 'none' AS segment, s_acctbal AS bal FROM supplier)
    SELECT coalesce(b.id, c.id) AS id, coalesce(name, '-') AS name,
      coalesce(CASE WHEN has_segment > 0 THEN c.segment ELSE b.segment END, '-') AS segment,
      coalesce(CASE WHEN has_bal > 0 THEN c.bal ELSE b.bal END, -1) AS bal
    FROM b FULL JOIN c ON b.id = c.id
    """,
)
def _(t):
    base = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "'none' AS segment", "s_acctbal AS bal")
    changes = t.orders.selectExpr(
        "o_custkey AS id",
        "o_orderkey AS seq",
        "CASE WHEN o_orderstatus = 'F' THEN named_struct('v', o_orderpriority) END AS segment",
        "CASE o_orderstatus WHEN 'O' THEN named_struct('v', o_totalprice)"
        " WHEN 'P' THEN named_struct('v', cast(null AS double)) END AS bal",
    )
    merged = mutations.set_fields(base, changes, "id", ["segment", "bal"], "seq")
    return merged.fillna({"name": "-", "segment": "-", "bal": -1.0})


@plan(
    "replace_rows",
    """
    SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT c_custkey, c_name FROM customer
    """,
)
def _(t):
    base = t.part.selectExpr("p_partkey AS id", "p_name AS name")
    new = t.customer.selectExpr("c_custkey AS id", "c_name AS name")
    return mutations.replace_rows(base, new, ["id"])


@plan(
    "delete_where",
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
    """,
)
def _(t):
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return mutations.delete_where(t.orders, gone).select("o_orderkey", "o_custkey")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'stopped' ELSE 'removed' END"
_ACTION = """
    CASE o_orderpriority WHEN '1-URGENT' THEN 'stop' WHEN '2-HIGH' THEN 'stop'
      WHEN '5-LOW' THEN 'snapshot' ELSE 'rm' END
"""


@plan(
    "guarded_transition",
    f"""
    WITH s AS (SELECT o_orderkey AS uuid, {_STATUS} AS status FROM orders),
    r AS (SELECT o_orderkey + 10 AS uuid, {_ACTION} AS action FROM orders)
    SELECT r.uuid, action,
      NOT (action = 'rm' AND (status IS NULL OR status <> 'stopped')) AS ok,
      CASE WHEN action = 'stop' AND status = 'running' THEN 'stopped'
           WHEN action = 'rm' AND status = 'stopped' THEN 'removed'
           WHEN action = 'rm' THEN 'Stack is running. Please stop first' ELSE 'running' END AS msg,
      coalesce(CASE WHEN action = 'stop' AND status = 'running' THEN 'stopped'
                    WHEN action = 'rm' AND status = 'stopped' THEN 'removed' ELSE status END, '?') AS status
    FROM r LEFT JOIN s ON r.uuid = s.uuid
    """,
)
def _(t):
    states = t.orders.select(F.col("o_orderkey").alias("uuid"), F.expr(_STATUS).alias("status"))
    requests = t.orders.select((F.col("o_orderkey") + 10).alias("uuid"), F.expr(_ACTION).alias("action"))
    return mutations.guarded_transition(requests, states, "uuid").fillna({"status": "?"})


@plan(
    "upsert_partitions",
    """
    WITH changed AS (
      SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0)
    SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed) AND NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
    UNION ALL SELECT * FROM changed
    """,
)
def _(t):
    """Orders by priority and status: some change, of these a third moves, and one partition goes."""
    name = f"orders_{uuid.uuid4().hex[:12]}"
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    keys = ["o_orderpriority", "o_orderstatus"]
    sinks.write_partitioned(t.orders.select(*columns), name, keys, scratch_path(t.spark, "partitioned"))
    changes = t.orders.filter("o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0").select(*columns)
    moved = F.when(F.col("o_orderkey") % 3 == 0, "9-NEW").otherwise(F.col("o_orderpriority"))
    first = changes.withColumn("seq", F.lit(0))
    last = changes.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderpriority": moved, "seq": F.lit(1)})
    table_changes.upsert_table(t.spark, name, first.unionByName(last), ["o_orderkey"], ["seq"])
    table_changes.delete_from_table(t.spark, name, F.expr("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"))
    return t.spark.table(name).select(*columns)


_REQUESTS = [
    "CASE WHEN l_orderkey % 97 = 0 THEN -1 ELSE l_orderkey END AS uuid",
    "l_shipdate AS asked",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "CASE WHEN l_quantity < 20 THEN 'stop' WHEN l_quantity < 35 THEN 'start' WHEN l_quantity < 45 THEN 'rm' ELSE 'snapshot' END AS action",
]


@plan(
    "transitions_in_turn",
    f"""
    WITH RECURSIVE s AS (SELECT o_orderkey AS uuid, {_STATUS} AS status FROM orders UNION ALL SELECT -1, 'running'),
    r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY asked, l_partkey, l_suppkey, l_linenumber, action) AS n
          FROM (SELECT {', '.join(_REQUESTS)} FROM lineitem)),
    turns AS (
      SELECT uuid, 0::BIGINT AS n, NULL::TIMESTAMP AS asked, NULL::VARCHAR AS action, true AS ok, '' AS msg, status FROM s
      UNION ALL
      SELECT t.uuid, r.n, r.asked, r.action, NOT (r.action = 'rm' AND status <> 'stopped') AS ok,
        CASE WHEN r.action = 'stop' AND status = 'running' THEN 'stopped'
             WHEN r.action = 'rm' AND status = 'stopped' THEN 'removed'
             WHEN r.action = 'start' AND status = 'stopped' THEN 'running'
             WHEN r.action = 'rm' THEN 'Stack is running. Please stop first' ELSE 'running' END AS msg,
        CASE WHEN r.action = 'stop' AND status = 'running' THEN 'stopped'
             WHEN r.action = 'rm' AND status = 'stopped' THEN 'removed'
             WHEN r.action = 'start' AND status = 'stopped' THEN 'running' ELSE status END AS status
      FROM turns t JOIN r ON t.uuid = r.uuid AND r.n = t.n + 1)
    SELECT uuid, asked, action, ok, msg, status FROM turns WHERE n > 0
    """,
)
def _(t):
    states = t.orders.select(F.col("o_orderkey").alias("uuid"), F.expr(_STATUS).alias("status"))
    states = states.unionByName(t.spark.createDataFrame([(-1, "running")], "uuid bigint, status string"))
    requests = t.lineitem.selectExpr(*_REQUESTS)
    rules = mutations.TRANSITIONS | {"start": ("stopped", "running")}
    done = mutations.transitions_in_turn(
        requests, states, "uuid", ["asked", "l_partkey", "l_suppkey", "l_linenumber", "action"], rules
    )
    return done.select("uuid", "asked", "action", "ok", "msg", "status")


@plan(
    "increment_counter",
    """
    SELECT c_custkey AS uuid, coalesce(n, 0) + 1 AS num_snapshots, coalesce(last, -1) AS snapshot_uuid
    FROM customer LEFT JOIN (
      SELECT o_custkey, count(*) AS n, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last
      FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey + 10
    """,
)
def _(t):
    base = t.customer.selectExpr("c_custkey AS uuid", "1L AS num_snapshots", "-1L AS snapshot_uuid")
    taken = t.orders.selectExpr("o_custkey + 10 AS uuid", "o_orderkey AS id", "o_orderdate AS ts")
    return mutations.increment_counter(
        base, taken, "uuid", "num_snapshots", "snapshot_uuid", "id", "ts"
    )


@plan(
    "delete_row_at",
    """
    SELECT s_suppkey, s_name FROM (
      SELECT *, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) WHERE rn <> 6
    """,
)
def _(t):
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    kept = mutations.delete_row_at(rows, ["s_acctbal", "s_suppkey"], 5, unique=True)
    return kept.drop("s_acctbal")


@plan("clear_rows", "SELECT p_partkey, p_name FROM part WHERE false")
def _(t):
    return mutations.clear_rows(t.part.select("p_partkey", "p_name"))


@plan(
    "insert_if_absent",
    """
    WITH rules AS (SELECT 'F' AS ip, c_custkey + 10 AS port FROM customer),
    asked AS (SELECT o_orderstatus AS ip, o_custkey AS port, o_custkey AS source_port, o_orderkey AS seq
              FROM orders),
    free AS (SELECT * FROM asked WHERE source_port NOT IN (SELECT s_suppkey FROM supplier)
             AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.ip = asked.ip AND r.port = asked.port)),
    firsts AS (SELECT min(seq) AS seq FROM free GROUP BY ip, port)
    SELECT ip, port, source_port, seq, seq IN (SELECT seq FROM firsts) AS accepted FROM asked
    """,
)
def _(t):
    rules = t.customer.selectExpr("'F' AS ip", "c_custkey + 10 AS port")
    asked = t.orders.selectExpr(
        "o_orderstatus AS ip", "o_custkey AS port", "o_custkey AS source_port", "o_orderkey AS seq"
    )
    reserved = t.supplier.selectExpr("s_suppkey AS source_port")
    return mutations.insert_if_absent(rules, asked, reserved, ["ip", "port"], "source_port", "seq")
