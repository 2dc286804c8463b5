"""Toxicity by a chain of linear classifiers.

The categories stand in a fixed order, and the last is toxicity as labelled.  Each has a
logistic model over the distinct words of a text (the word itself and its beginnings), and
over the probabilities of the categories before it.  While fitting, those earlier
probabilities are out of fold: a row gets them from models that have not seen it, so later
models learn how far the earlier ones can be trusted.

The labels know one mark, so the categories before it are found in the data: words that stand out in toxic
rows, in the sample without any one fold, are split into two groups by the toxic rows they share,
and a toxic row is an example of the groups whose words it holds.

A feature weighs log(1 + n) for the n distinct words of a text that have it, in fitting and in scoring.
Workers cache the features of a word; the counts belong to a text.  Fitting uses a bounded sample of rows,
whole texts of it; the driver gets the counts of features of at least ``MIN_ROWS`` rows, as no others can be
chosen.  The penalty of the weights is the one of ``PENALTIES`` with the least out-of-fold loss.  Scoring runs
inside the map tasks over whole texts, without a shuffle.

Cases: null and empty texts have no words and get the models' base rates; very long texts
are read whole; equal texts get equal scores; of rows that share a labelled id one is learnt from; an empty
table gives no rows; a category without examples of both kinds gets its share everywhere; other columns pass
through, columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import labelled_sample
from millrace.scratch import persist_table, release_table

CATEGORIES = ("group_1", "group_2", "toxic")
STANDING_OUT = 3.0  # deviations by which a word is more frequent in toxic rows than chance allows
GROUPED = 60  # words at most that make the groups

BEGINNINGS = (4, 5, 6, 7)
FOLDS = 4
FEATURES = 1200
MIN_ROWS = 3
PENALTIES = (1e-4, 1e-3, 3e-3)  # of the sum of weights
SHRINK = 1e-3  # of the sum of their squares
CACHE_ENTRIES = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def counts_of(words: set[str]) -> Counter:
    return Counter(f for w in words for f in features_of(w))


@dataclass
class Linear:
    """Weights by feature, weights of the categories before, and a base."""

    weights: dict[str, float]
    before: list[float]
    base: float


class Sample:
    """Feature counts of the sampled rows; only features of at least ``MIN_ROWS`` rows."""

    def __init__(self, rows: list[Counter]):
        df = Counter(f for row in rows for f in row)
        self.names = sorted(f for f, n in df.items() if n >= MIN_ROWS)
        place = {f: i for i, f in enumerate(self.names)}
        self.cells = [
            (np.array([place[f] for f in row if f in place], np.int64),
             np.log1p(np.array([n for f, n in row.items() if f in place], np.float32)))
            for row in rows
        ]

    def deviations(self, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """How far each feature's rows among ``at`` with label 1 are above what their share lets expect."""
        width = len(self.names)
        cells = [self.cells[i][0] for i in at]
        seen = np.bincount(np.concatenate(cells), minlength=width)
        ones = [c for c, y in zip(cells, labels, strict=True) if y] or [np.zeros(0, np.int64)]
        here = np.bincount(np.concatenate(ones), minlength=width)
        share = labels.mean()
        found = (here - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
        found[seen < MIN_ROWS] = 0
        return found

    def telling(self, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The features whose presence in the rows ``at`` says most about the label."""
        return np.argsort(-np.abs(self.deviations(at, labels)), kind="stable")[:FEATURES]

    def matrix(self, at: np.ndarray, features: np.ndarray) -> np.ndarray:
        column = np.full(len(self.names), -1)
        column[features] = np.arange(len(features))
        x = np.zeros((len(at), len(features)), np.float32)
        for row, i in enumerate(at):
            f, n = self.cells[i]
            c = column[f]
            x[row, c[c >= 0]] = n[c >= 0]
        return x


def _fit_one(
    sample: Sample, at: np.ndarray, before: np.ndarray, labels: np.ndarray, penalty: float, rounds: int = 120
) -> tuple[Linear, np.ndarray]:
    """A model of the rows ``at``, and the features that it uses."""
    if not len(sample.names) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        return Linear({}, [0.0] * before.shape[1], float(np.log(share / (1 - share)))), np.zeros(0, np.int64)
    features = sample.telling(at, labels)
    x = np.concatenate([sample.matrix(at, features), before.astype(np.float32)], 1)
    w, base = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + base, -30, 30)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        g = np.append(x.T @ error + SHRINK * w + penalty * np.sign(w), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = (w - move[:-1]).astype(np.float32)
        base -= move[-1]
    weights = {sample.names[f]: float(w[k]) for k, f in enumerate(features) if abs(w[k]) > 1e-3}
    return Linear(weights, [float(b) for b in w[len(features) :]], float(base)), features


def _scores(model: Linear, sample: Sample, at: np.ndarray, features: np.ndarray, before: np.ndarray) -> np.ndarray:
    w = np.array([model.weights.get(sample.names[f], 0.0) for f in features], np.float32)
    z = sample.matrix(at, features) @ w + before @ np.array(model.before, np.float32) + model.base
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def word_groups(sample: Sample, labels: np.ndarray) -> list[np.ndarray]:
    """Two groups of words that stand out in rows with label 1, whichever fold is left out; they may be empty."""
    every, least = np.arange(len(labels)), None
    for f in range(FOLDS):
        part = every[every % FOLDS != f]
        if not len(part) or not len(sample.names) or labels[part].min() == labels[part].max():
            return [np.zeros(0, np.int64)] * 2
        found = sample.deviations(part, labels[part])
        least = found if least is None else np.minimum(least, found)
    words = np.array([n.startswith("=") for n in sample.names])
    best = np.flatnonzero(words & (least >= STANDING_OUT))
    best = best[np.argsort(-least[best], kind="stable")][:GROUPED]
    if len(best) < 2:
        return [best, np.zeros(0, np.int64)]
    rows = sample.matrix(every[labels == 1], best) > 0
    shape = rows.T / np.maximum(np.linalg.norm(rows, axis=0), 1e-9)[:, None]
    alike = shape @ shape.T
    first, second = np.unravel_index(alike.argmin(), alike.shape)  # the two that share the fewest rows
    centres = shape[[first, second]]
    for _ in range(20):
        side = (shape @ centres.T).argmax(1)
        centres = np.stack([shape[side == g].sum(0) if (side == g).any() else centres[g] for g in (0, 1)])
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return [best[side == g] for g in (0, 1)]


def marks_of(sample: Sample, labels: np.ndarray) -> np.ndarray:
    """A column for each group (toxic rows that hold a word of it), and the labels."""
    every = np.arange(len(labels))
    held = [
        (sample.matrix(every, g) > 0).any(1) if len(g) else np.zeros(len(labels), bool) for g in word_groups(sample, labels)
    ]
    return np.column_stack([*[h * labels for h in held], labels]).astype(np.float32)


def _out_of_fold(sample: Sample, before: np.ndarray, labels: np.ndarray, penalty: float) -> np.ndarray:
    every, fresh = np.arange(len(labels)), np.zeros(len(labels), np.float32)
    for f in range(FOLDS):
        learn, judge = every[every % FOLDS != f], every[every % FOLDS == f]
        if len(learn) and len(judge):
            model, features = _fit_one(sample, learn, before[learn], labels[learn], penalty)
            fresh[judge] = _scores(model, sample, judge, features, before[judge])
    return fresh


def best_penalty(sample: Sample, labels: np.ndarray) -> float:
    none = np.zeros((len(labels), 0), np.float32)
    losses = []
    for penalty in PENALTIES:
        p = np.clip(_out_of_fold(sample, none, labels, penalty), 1e-3, 1 - 1e-3)
        losses.append(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))
    return PENALTIES[int(np.argmin(losses))]


def fit_chain(rows: list[Counter], labels: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``, fed with out-of-fold probabilities of the earlier ones."""
    sample, every = Sample(rows), np.arange(len(rows))
    penalty = best_penalty(sample, labels[:, -1])
    before = np.zeros((len(rows), 0), np.float32)
    chain = []
    for k in range(labels.shape[1]):
        chain.append(_fit_one(sample, every, before, labels[:, k], penalty)[0])
        if k + 1 < labels.shape[1]:
            before = np.column_stack([before, _out_of_fold(sample, before, labels[:, k], penalty)])
    return chain


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    rows_per_class: int = 1200,
) -> list[Linear]:
    """Learn the chain from a bounded sample of the labelled rows that are not held out."""

    @F.pandas_udf("array<string>")
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([list(counts_of(distinct_words(t))) for t in texts])

    sample = labelled_sample(docs.select(doc_id, text), labels, label, rows_per_class, doc_id, text)
    sample = persist_table(sample, "sample")
    common = sample.select(F.explode(named(F.col(text))).alias("f")).groupBy("f").count().filter(F.col("count") >= MIN_ROWS)
    shared = docs.sparkSession.sparkContext.broadcast({r["f"] for r in common.select("f").collect()})

    @F.pandas_udf("names array<string>, counts array<int>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = sorted((f, n) for f, n in counts_of(distinct_words(t)).items() if f in shared.value)
            out.append(([f for f, _ in found], [n for _, n in found]))
        return pd.DataFrame(out, columns=["names", "counts"])

    rows = sample.select(doc_id, "__label", counted(F.col(text)).alias("w")).select(doc_id, "__label", "w.*").collect()
    release_table(sample)
    rows.sort(key=lambda r: r[doc_id])
    if not rows:
        return [Linear({}, [0.0] * k, 0.0) for k in range(len(CATEGORIES))]
    counts = [Counter(dict(zip(r["names"], r["counts"], strict=True))) for r in rows]
    known = np.array([r["__label"] for r in rows], np.float32)
    return fit_chain(counts, marks_of(Sample(counts), known))


class Chain:
    """Scores texts in one Python worker; the features of a word that have weights are cached."""

    def __init__(self, chain: list[Linear]):
        self.chain, self.words = chain, {}
        names = sorted({f for m in chain for f in m.weights})
        self.place = {f: i for i, f in enumerate(names)}
        self.weights = np.array([[m.weights.get(f, 0.0) for m in chain] for f in names]).reshape(len(names), len(chain))

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            found = [self.place[f] for f in features_of(word) if f in self.place]
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            self.words[word] = found
        return found

    def score(self, text: str | None) -> list[float]:
        sums = [m.base for m in self.chain]
        seen = [f for found in map(self.word, distinct_words(text)) for f in found]
        if seen:
            counts = np.bincount(seen)
            here = np.flatnonzero(counts)
            sums = sums + np.log1p(counts[here]) @ self.weights[here]
        out: list[float] = []
        for z, model in zip(sums, self.chain, strict=True):
            z += sum(w * p for w, p in zip(model.before, out, strict=True))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return out


def score(docs: DataFrame, chain: list[Linear], text: str = "text") -> DataFrame:
    """Add ``p_<category>`` for every category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by FEATURES per category

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Chain(shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts])

    rows = docs.withColumn("__p", probabilities(F.col(text)))
    names = {f"p_{name}": F.col("__p")[i] for i, name in enumerate(CATEGORIES)}
    return rows.withColumns(names).drop("__p")
