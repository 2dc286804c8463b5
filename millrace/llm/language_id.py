"""Language of whole texts by hierarchical discrimination: the family first, then its languages.

A text is lower-cased; ASCII characters other than letters become spaces, runs of spaces one.
Its 1- to 4-grams of UTF-8 bytes are counted in ``SIZE`` hashed buckets, and the square roots of their
shares are the features (their length is 1, however long the text is).  Languages whose mean features
are alike form families (average linkage, about the square root of their number).  A linear
support vector machine for each family against the rest picks the family; inside it, one machine
for each pair of languages, fitted on these two alone, casts a vote.

Fitting uses at most ``sample_rows`` distinct texts in all, an equal share for each of the
``languages`` most frequent languages, picked by the hash of the text; what comes to the driver are
their bucket counts.  Scoring runs over every byte of every text, in pieces of bounded size.

Cases: null texts and texts without a letter are ``und`` with score 0, and never learnt from;
null languages and null ids are not learnt from; very long texts are counted in pieces; equal
texts get equal results, and a text that fills much of the table is learnt from once for each language; with
one language every text with letters is of it; without any, or with an empty table, all is
``und``; other columns pass through, columns named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows with this remainder of crc32(id as text) are never learnt from.
FOLDS, HELD_OUT = 3, 1

UNKNOWN = "und"
BITS = 14
SIZE = 1 << BITS
GRAMS = 4
PIECE = 1 << 20  # bytes counted at a time
SOFTNESS, ROUNDS = 10.0, 1000  # penalty of errors, rounds over the sample at most
STEEPNESS = 4.0  # from margins to shares of one

_BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte 1- to 4-grams of a whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8)
    data = data[np.r_[True, (data[1:] != 32) | (data[:-1] != 32)]]
    total = np.zeros(SIZE, np.int64)
    for start in range(0, len(data), PIECE):
        # Each gram is counted in the piece in which it begins.
        piece = data[start : start + PIECE + GRAMS - 1].astype(np.uint32)
        begins = min(PIECE, len(data) - start)
        rolled = np.zeros(len(piece), np.uint32)
        for n in range(1, GRAMS + 1):
            if len(piece) < n:
                break
            rolled = rolled[: len(piece) - n + 1] * np.uint32(0x01000193) + piece[n - 1 :] + np.uint32(n)
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            total += np.bincount(mixed[:begins] >> np.uint32(32 - BITS), minlength=SIZE)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares; rows of length one."""
    counts = counts.astype(np.float32, copy=False)
    shares = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return np.sqrt(shares, out=shares)


def fit_machine(gram: np.ndarray, signs: np.ndarray, seed: int = 13) -> np.ndarray:
    """Dual weights of a linear support vector machine with squared loss, by coordinate descent.

    ``gram`` holds the products of all pairs of rows (with the constant feature), ``signs`` is 1 or -1.
    """
    rng = np.random.default_rng(seed)
    alpha, answers = np.zeros(len(signs)), np.zeros(len(signs))
    loose = 1 / (2 * SOFTNESS)
    for _ in range(ROUNDS):
        largest = 0.0
        for i in rng.permutation(len(signs)):
            slope = signs[i] * answers[i] - 1 + loose * alpha[i]
            new = max(alpha[i] - slope / (gram[i, i] + loose), 0.0)
            if step := new - alpha[i]:
                answers += (step * signs[i]) * gram[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return alpha * signs


def families_of(means: np.ndarray) -> list[list[int]]:
    """Languages grouped by average linkage of their mean features, about sqrt(n) groups."""
    alike = means @ means.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(
            combinations(range(len(groups)), 2), key=lambda p: (alike[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1])
        )
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


class Model(NamedTuple):
    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    """Languages of the same family, the first is on the positive side."""
    weights: np.ndarray
    """A column for each family, then for each pair; the last row is the constant."""


def fit(languages: list[str], counts: np.ndarray, labels: np.ndarray) -> Model:
    """Fit all machines; ``labels`` are places in ``languages``, ``counts`` a row for each text."""
    x = features(counts)
    means = np.stack([x[labels == k].mean(0) for k in range(len(languages))])
    families = families_of(means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9))
    gram = (x @ x.T).astype(np.float64) + 1
    columns = []

    def machine(rows: np.ndarray, positive: np.ndarray) -> None:
        found = np.zeros(len(labels), np.float32)
        found[rows] = fit_machine(gram[np.ix_(rows, rows)], np.where(positive, 1.0, -1.0))
        columns.append(np.append(found @ x, found.sum()))

    for family in families if len(families) > 1 else []:
        machine(np.arange(len(labels)), np.isin(labels, family))
    pairs = [p for family in families for p in combinations(family, 2)]
    for a, b in pairs:
        rows = np.flatnonzero((labels == a) | (labels == b))
        machine(rows, labels[rows] == a)
    weights = np.stack(columns, 1) if columns else np.zeros((SIZE + 1, 0))
    return Model(languages, families, pairs, weights.astype(np.float32))


def predict(model: Model, text: str) -> tuple[str, float]:
    """The language, and the share of belief in its family times that in it among its family."""
    answers = features(gram_counts(text)) @ model.weights[:-1] + model.weights[-1]
    sure = 1.0
    family = model.families[0]
    n = len(model.families) if len(model.families) > 1 else 0
    if n:
        belief = np.exp(STEEPNESS * (answers[:n] - answers[:n].max()))
        best = int(answers[:n].argmax())
        family, sure = model.families[best], float(belief[best] / belief.sum())
    votes = {k: [0, 0.0] for k in family}
    for (a, b), margin in zip(model.pairs, answers[n:], strict=True):
        if a in votes:
            for k, side in ((a, margin), (b, -margin)):
                votes[k][0] += side > 0
                votes[k][1] += 1 / (1 + np.exp(-STEEPNESS * float(side)))
    # Most votes, then most belief; names in order at last.
    chosen = max(family, key=lambda k: (*votes[k], -k))
    if len(family) > 1:
        sure *= votes[chosen][1] / (len(family) - 1)
    return model.languages[chosen], min(max(float(sure), 0.0), 1.0)


def fit_model(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 1200,
    languages: int = 64,
) -> Model | None:
    """Learn from a bounded sample of the rows that are not held out; None if there is nothing to learn."""

    @F.pandas_udf("binary")
    def packed_counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([zlib.compress(gram_counts(t).tobytes(), 1) for t in texts])

    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("id")) & has_letter(F.col("text"))
    )
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in most)
    if not names:
        return None
    # Only the best ranks of each task reach the shuffle, whatever share of the rows a language has.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = known.select("lang", "h").filter(F.col("lang").isin(names)).distinct()
    picked = picked.withColumn("rank", rank).filter(F.col("rank") <= max(sample_rows // len(names), 1)).drop("rank")
    sample = known.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])
    rows = sample.select("lang", "h", packed_counts("text").alias("c")).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    counts = np.empty((len(rows), SIZE), np.float32)
    for i, r in enumerate(rows):
        counts[i] = np.frombuffer(zlib.decompress(r["c"]), np.int64)
    return fit(names, counts, np.array([names.index(r["lang"]) for r in rows]))


def predict_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    # One column of weights for each family and pair, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [predict(shared.value, t) if t is not None else (UNKNOWN, 0.0) for t in texts]
            yield pd.DataFrame(found, columns=["lang", "score"])

    readable = F.when(has_letter(F.col(text)), F.col(text))
    rows = docs.withColumn("__guess", guess(readable))
    return rows.withColumns({"lang_pred": F.col("__guess.lang"), "score": F.col("__guess.score")}).drop("__guess")
