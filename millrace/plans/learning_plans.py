"""Learning jobs and generated graphs on the test tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.functions.strings import words
from millrace.operators import aggregates, graph, joins, learning
from millrace.plans.aggregate_plans import CENTRES_SQL, label_centres
from millrace.plans.join_plans import RATINGS_SQL, ratings
from millrace.plans.registry import plan
from millrace.scratch import persist_table


def judged_documents(t):
    """Length and word count (in thousands) of the judged documents with their quality."""
    size = F.size(words(F.col("text"))).cast("double")
    docs = t.documents.select("doc_id", (F.col("n_chars") / 1000.0).alias("chars"), (size / 1000.0).alias("tokens"))
    return t.labels.select("doc_id", "quality").join(docs, "doc_id")


def judged_points(t):
    """The judged documents as points, written once: fitting and scoring read them many times."""
    rows = persist_table(judged_documents(t), "judged")
    return learning.labelled(rows, F.col("quality"), F.array("chars", "tokens"))


@plan("train_logistic")
def _(t):
    points = judged_points(t)
    model = learning.train_logistic(points)
    scored = model.transform(points).select("label", "prediction")
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("cnt"))


@plan("logistic_training_error")
def _(t):
    points = judged_points(t)
    scored = learning.train_logistic(points).transform(points)
    return aggregates.training_error(scored, "label", "prediction")


@plan(
    "train_linear",
    """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept
    FROM lineitem
    """,
)
def _(t):
    points = learning.labelled(t.lineitem, F.col("l_extendedprice"), F.array("l_quantity"))
    model = learning.train_linear(points)
    fitted = [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 3))]
    return t.spark.createDataFrame(fitted, "slope double, intercept double")


@plan(
    "closed_form_line",
    """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
           round((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2
             / regr_sxx(l_extendedprice, l_quantity)) / count(*) / 1000, 2) AS mse_thousands
    FROM lineitem
    """,
)
def _(t):
    fitted = learning.closed_form_line(t.lineitem, "l_quantity", "l_extendedprice")
    return fitted.select(
        F.round("slope", 3).alias("slope"),
        F.round("intercept", 3).alias("intercept"),
        F.round(F.col("mse") / 1000, 2).alias("mse_thousands"),
    )


@plan("train_kmeans")
def _(t):
    points = learning.vectors(t.embeddings.select("vec_id", "embedding"), "embedding")
    model = learning.train_kmeans(points)
    centres = learning.centres_frame(t.spark, model)
    placed = learning.assign_clusters(t.embeddings, centres, "embedding")
    return placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("points"), F.sum("distance").alias("wssse")
    )


@plan(
    "assign_clusters",
    f"""
    WITH {CENTRES_SQL},
    d AS (SELECT vec_id, c.label AS cluster, list_distance(p, centre) AS distance
          FROM points, centres c)
    SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, round(min(distance), 5) AS distance
    FROM d GROUP BY vec_id
    """,
)
def _(t):
    placed = learning.assign_clusters(
        t.embeddings.select("vec_id", "embedding"), label_centres(t), "embedding", "label"
    )
    return placed.select("vec_id", F.col("label").alias("cluster"), F.round("distance", 5).alias("distance"))


def written_ratings(t):
    """Ratings, written once, as fitting and scoring read them many times."""
    return persist_table(ratings(t), "ratings")


@plan("predict_pairs")
def _(t):
    known = written_ratings(t)
    return learning.predict_pairs(learning.train_als(known), known)


@plan("train_als")
def _(t):
    known = written_ratings(t)
    predicted = learning.predict_pairs(learning.train_als(known), known)
    both = joins.join_actual_predicted(known, predicted)
    return aggregates.mean_squared_error(both, "rating", "prediction")


# Fitted models have no SQL; what must hold for any right fit, in figures of the tables, has.


@plan(
    "train_logistic_sums",
    """
    SELECT count(*) AS points, sum(quality)::BIGINT AS positives, sum(quality)::BIGINT AS fitted_positives, true AS beats_majority
    FROM labels JOIN documents USING (doc_id)
    """,
)
def _(t):
    """At the optimum with an intercept the probabilities add up to the number of positive points."""
    points = judged_points(t)
    scored = learning.train_logistic(points).transform(points)
    scored = scored.withColumn("p", vector_to_array("probability")[1])
    right = F.count_if(F.col("label") == F.col("prediction"))
    positives = F.sum("label").cast("bigint")
    return scored.agg(
        F.count(F.lit(1)).alias("points"),
        positives.alias("positives"),
        F.round(F.sum("p")).cast("bigint").alias("fitted_positives"),
        (right >= 0.9 * F.greatest(positives, F.count(F.lit(1)) - positives)).alias("beats_majority"),
    )


@plan(
    "train_kmeans_sums",
    """
    SELECT 2::BIGINT AS clusters, count(*) AS points, true AS less_than_one_cluster, true AS cost_is_of_nearest FROM embeddings
    """,
)
def _(t):
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    model = learning.train_kmeans(learning.vectors(vectors, "x"))
    placed = learning.assign_clusters(vectors, learning.centres_frame(t.spark, model), "x")
    whole = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("var"), F.count("v").alias("n"))
    scatter = whole.agg(F.sum(F.col("var") * F.col("n")).alias("scatter")).scalar()
    squares = F.sum(F.col("distance") * F.col("distance"))
    return placed.agg(
        F.count_distinct("cluster").alias("clusters"),
        F.count(F.lit(1)).alias("points"),
        (squares < scatter).alias("less_than_one_cluster"),
        (F.abs(squares / model.cost - 1) < 1e-6).alias("cost_is_of_nearest"),
    )


@plan(
    "predict_pairs_found",
    f"""
    WITH {RATINGS_SQL}
    SELECT user::BIGINT AS user, count(*) AS items, sum(item)::BIGINT AS item_sum, true AS finite, true AS beats_mean FROM ratings GROUP BY user
    """,
)
def _(t):
    """Every rated pair has a prediction, and over all pairs they are nearer than the mean rating."""
    known = written_ratings(t)
    predicted = learning.predict_pairs(learning.train_als(known), known)
    both = persist_table(joins.join_actual_predicted(known, predicted), "predicted")
    error = both.agg(F.avg(F.pow(F.col("rating") - F.col("prediction"), F.lit(2)))).scalar()
    variance = known.agg(F.var_pop("rating")).scalar()
    return both.groupBy("user").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("item").alias("item_sum"),
        F.bool_and(~F.isnan("prediction") & (F.abs("prediction") < 1e9)).alias("finite"),
        (F.max(error) < F.max(variance)).alias("beats_mean"),
    )


@plan(
    "estimate_pi",
    """
    WITH u AS (SELECT
        ('0x' || left(md5('x1-' || id), 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS x,
        ('0x' || left(md5('y1-' || id), 15))::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE AS y
      FROM range((SELECT count(*) FROM lineitem)) g(id))
    SELECT round(count(*) FILTER (x * x + y * y <= 1.0::DOUBLE) * 4.0::DOUBLE / count(*), 8) AS pi FROM u
    """,
)
def _(t):
    return learning.estimate_pi(t.spark, t.lineitem.count()).select(F.round("pi", 8).alias("pi"))


@plan(
    "generate_attachment_graph",
    """
    WITH RECURSIVE d AS (
      SELECT src, ('0x' || left(md5('11-' || src), 15))::BIGINT % (2 * src - 1) AS slot
      FROM range(1, (SELECT count(*) FROM part) + 1) g(src)),
    e AS (SELECT src, CASE WHEN slot % 2 = 0 THEN slot // 2 END AS dst,
                 CASE WHEN slot % 2 = 1 THEN (slot + 1) // 2 END AS via FROM d),
    r AS (SELECT src, dst, via FROM e
          UNION ALL SELECT r.src, e.dst, e.via FROM r JOIN e ON r.via = e.src)
    SELECT src, dst FROM r WHERE via IS NULL
    """,
)
def _(t):
    return graph.generate_attachment_graph(t.spark, t.part.count(), seed=11)


@plan(
    "generated_degree_histogram",
    """
    WITH RECURSIVE d AS (
      SELECT src, ('0x' || left(md5('11-' || src), 15))::BIGINT % (2 * src - 1) AS slot
      FROM range(1, (SELECT count(*) FROM part) + 1) g(src)),
    e AS (SELECT src, CASE WHEN slot % 2 = 0 THEN slot // 2 END AS dst,
                 CASE WHEN slot % 2 = 1 THEN (slot + 1) // 2 END AS via FROM d),
    r AS (SELECT src, dst, via FROM e
          UNION ALL SELECT r.src, e.dst, e.via FROM r JOIN e ON r.via = e.src),
    v AS (SELECT unnest(range((SELECT count(*) FROM part) + 1)) AS id),
    n AS (SELECT id, count(dst) AS degree FROM v LEFT JOIN (SELECT * FROM r WHERE via IS NULL) ON id = dst
          GROUP BY id)
    SELECT degree, count(*) AS vertices FROM n GROUP BY degree
    """,
)
def _(t):
    n = t.part.count()
    drawn = graph.generate_attachment_graph(t.spark, n, seed=11)
    linked = drawn.select(F.col("src").alias("_outV"), F.col("dst").alias("_inV"))
    ids = t.spark.range(n + 1).withColumnRenamed("id", "_id")
    return aggregates.degree_histogram(graph.in_degree(ids, linked))
