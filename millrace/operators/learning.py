"""Regression, classification, clustering and recommendation on MLlib."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import distance
from millrace.functions.hashing import unit_interval
from millrace.operators.numbering import number_rows
from millrace.scratch import persist_table

# The training parameters of the jobs.
KMEANS_CLUSTERS = 2
KMEANS_ITERATIONS = 10
KMEANS_RUNS = 30
ALS_RANK = 1
ALS_ITERATIONS = 20
ALS_LAMBDA = 0.01


def labelled(df: DataFrame, label: Column, features: Column) -> DataFrame:
    """``label, features`` rows for MLlib from a number and an array of doubles."""
    return df.select(
        label.cast("double").alias("label"),
        array_to_vector(features.cast("array<double>")).alias("features"),
    )


def vectors(df: DataFrame, col: str) -> DataFrame:
    """``features`` vectors for MLlib from an array column."""
    return df.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def train_logistic(points: DataFrame, **params) -> LogisticRegressionModel:
    """Binary logistic regression with default settings."""
    return LogisticRegression(**params).fit(points)


def train_linear(points: DataFrame, fit_intercept: bool = True, **params) -> LinearRegressionModel:
    """Linear least squares; the closed-form solver applies up to 4096 features."""
    return LinearRegression(fitIntercept=fit_intercept, **params).fit(points)


def closed_form_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and mean squared error of ``y`` on one feature, in one pass."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        ((F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x))
         / F.regr_count(y, x)).alias("mse"),
    )


class Clusters(NamedTuple):
    """The centres of the cheapest run, and the sum of squared distances to them."""

    centres: np.ndarray
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)


def train_kmeans(
    points: DataFrame,
    k: int = KMEANS_CLUSTERS,
    max_iter: int = KMEANS_ITERATIONS,
    runs: int = KMEANS_RUNS,
    seed: int = 1,
    tolerance: float = 1e-4,
) -> Clusters:
    """The cheapest of ``runs`` randomly started fits.

    One pass over the points moves the centres of all runs: a task measures its points against ``runs * k``
    centres and sends one sum for each, so the number of passes is that of the iterations.
    Starts are distinct points picked by hash; a centre without points stays where it is.
    """
    cached = points.select(vector_to_array("features").alias("x")).filter("x is not null").persist()
    try:
        by_hash = F.xxhash64(F.lit(seed), "x")
        picked = cached.select("x", by_hash.alias("h")).distinct().orderBy("h").limit(runs * k).collect()
        starts = np.array([r["x"] for r in picked])
        if len(starts) < k:
            raise ValueError(f"{len(starts)} distinct points are fewer than {k} clusters")
        rng = np.random.default_rng(seed)
        centres = np.stack([starts[rng.choice(len(starts), k, replace=False)] for _ in range(runs)])
        for _ in range(max_iter):
            counts, sums, _ = _lloyd_sums(cached, centres)
            moved = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres)
            still = ((moved - centres) ** 2).sum(-1).max() <= tolerance**2
            centres = moved
            if still:
                break
        _, _, costs = _lloyd_sums(cached, centres)
        best = int(costs.argmin())
        return Clusters(centres[best], float(costs[best]))
    finally:
        cached.unpersist()


def _lloyd_sums(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run and cluster the number and the sum of its nearest points, and each run's cost."""
    runs, k, width = centres.shape
    flat = centres.reshape(runs * k, width)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums, cost = np.zeros(runs * k), np.zeros((runs * k, width)), np.zeros(runs)
        for batch in batches:
            for low in range(0, len(batch), 4096):
                x = np.stack(batch["x"].iloc[low : low + 4096])
                squares = (x**2).sum(1)[:, None] - 2 * x @ flat.T + (flat**2).sum(1)
                near = squares.reshape(len(x), runs, k).argmin(2)
                own = near + np.arange(runs) * k
                cost += np.maximum(np.take_along_axis(squares, own, 1), 0).sum(0)
                counts += np.bincount(own.ravel(), minlength=runs * k)
                chosen = np.zeros((len(x), runs * k))
                np.put_along_axis(chosen, own, 1, 1)
                sums += chosen.T @ x
        values = np.column_stack([counts, sums, np.repeat(cost, k)])
        yield pd.DataFrame({"place": np.arange(values.size), "value": values.ravel()})

    # One number for each coordinate of each centre reaches the driver, whatever the number of points.
    added = points.mapInPandas(add_up, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = np.zeros((runs * k, width + 2))
    for r in added.collect():
        values.flat[r["place"]] = r["value"]
    values = values.reshape(runs, k, width + 2)
    return values[..., 0], values[..., 1:-1], values[:, 0, -1]


def centres_frame(spark: SparkSession, model: Clusters) -> DataFrame:
    """``cluster, centre`` of a fitted model (k rows)."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def assign_clusters(
    points: DataFrame, centres: DataFrame, point: str, cluster: str = "cluster", centre: str = "centre"
) -> DataFrame:
    """Nearest centre of every point with its distance; the lower cluster id wins a tie.

    The centres are one array per plan (k is a parameter of the job, not data), so each
    point is handled where it is, without a shuffle.
    """
    listed = centres.agg(
        F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("id"), F.col(centre).alias("at"))))
        .alias("c")
    ).scalar()
    measured = points.withColumn("__centres", listed).withColumn(
        "__best",
        F.array_min(
            F.transform(
                "__centres",
                lambda c: F.struct(distance(F.col(point), c["at"]).alias("d"), c["id"].alias("id")),
            )
        ),
    )
    return measured.select(
        *points.columns,
        F.col("__best.id").alias(cluster),
        F.col("__best.d").alias("distance"),
    )


class Factors(NamedTuple):
    """A fitted factorisation with the dense numbers of its users and items."""

    model: ALSModel
    users: DataFrame
    items: DataFrame


def dense_numbers(ids: DataFrame, name: str) -> DataFrame:
    """``name, number``: the distinct ids, which may be of any type, numbered from 1; null has no number."""
    numbered = number_rows(ids.select(name).filter(F.col(name).isNotNull()).distinct(), name, "number")
    return persist_table(numbered, "numbers")


def _numbered(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Add the numbers ``u, i`` of users and items; pairs with an unknown one go."""
    known = pairs.join(users.withColumnRenamed("number", "u"), "user")
    known = known.join(items.withColumnRenamed("number", "i"), "item")
    # More than 2^31 users or items fail here, as the factorisation numbers them with integers.
    return known.withColumns({"u": F.col("u").cast("int"), "i": F.col("i").cast("int")})


def train_als(
    ratings: DataFrame,
    rank: int = ALS_RANK,
    max_iter: int = ALS_ITERATIONS,
    reg: float = ALS_LAMBDA,
    seed: int = 1,
    blocks: int | None = None,
) -> Factors:
    """Matrix factorisation of ``user, item, rating``; ids may be of any type and size.

    Users and items are dealt to ``blocks`` tasks each, by default as many as a shuffle has.
    """
    blocks = blocks or int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    als = ALS(
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        seed=seed,
        userCol="u",
        itemCol="i",
        ratingCol="rating",
        coldStartStrategy="drop",
    )
    users, items = dense_numbers(ratings, "user"), dense_numbers(ratings, "item")
    return Factors(als.fit(_numbered(ratings, users, items).select("u", "i", "rating")), users, items)


def predict_pairs(factors: Factors, pairs: DataFrame) -> DataFrame:
    """Predicted rating of every (user, item) whose user and item were trained on.

    The factors go to the ids first, so each pair meets its user and its item in one join each.
    """
    by_id = {}
    for name, ids, fitted in (("user", factors.users, factors.model.userFactors), ("item", factors.items, factors.model.itemFactors)):
        found = ids.join(fitted.withColumnRenamed("id", "number"), "number")
        by_id[name] = found.select(name, F.col("features").alias(f"__{name}"))
    met = pairs.select("user", "item").join(by_id["user"], "user").join(by_id["item"], "item")
    products = F.zip_with("__user", "__item", lambda u, i: u * i)
    dot = F.aggregate(products, F.lit(0.0).cast("float"), lambda s, x: s + x)
    return met.select("user", "item", dot.cast("double").alias("prediction")).filter(~F.isnan("prediction"))


def estimate_pi(spark: SparkSession, samples: int, seed: int = 1) -> DataFrame:
    """Share of points of the unit square that fall into the quarter circle, times four."""
    x = unit_interval(f"x{seed}", F.col("id"))
    y = unit_interval(f"y{seed}", F.col("id"))
    inside = F.count_if(x * x + y * y <= 1.0)
    return spark.range(samples).agg((inside * 4.0 / F.count(F.lit(1))).alias("pi"))
