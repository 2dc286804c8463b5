"""Language identification: held-out accuracy, the fitted machines, pieces of long texts, odd tables."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import tables
from millrace.llm import language_id, plans

DOCS = "doc_id bigint, text string, lang string, score string, bucket int"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_language_on_held_out_rows(spark, sf):
    path = f"/root/testdata/{sf}"
    if not os.path.isdir(path):
        pytest.skip("test tables are not here")
    docs = tables.load(spark, path, "documents")
    df = plans.QUERIES["op13_language_id"](spark, path).cache()
    assert df.count() == docs.count()
    assert df.filter(~F.col("score").between(0, 1)).count() == 0
    known = df.filter("held_out").join(docs, "doc_id")
    assert known.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert df.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 3 == 1)).count() == 0


def counted(text):
    """The bucket counts, gram by gram."""
    data = b" " + b" ".join(text.lower().encode().translate(language_id._BLANK).split(b" ")) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    out = np.zeros(language_id.SIZE, np.int64)
    for i in range(len(data)):
        rolled = 0
        for n in range(1, language_id.GRAMS + 1):
            if i + n <= len(data):
                rolled = (rolled * 0x01000193 + data[i + n - 1] + n) % 2**32
                out[((rolled ^ (rolled >> 15)) * 0x9E3779B1) % 2**32 >> (32 - language_id.BITS)] += 1
    return out


def test_pieces_do_not_change_counts(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "É a  b!!c", *("".join(rng.choices("abc dé!. ", k=n)) for n in (10, 63, 64, 65, 500))]
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t in texts:
            assert (language_id.gram_counts(t) == counted(t)).all()


def test_machine_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    signs = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    gram = x @ x.T + 1
    found = language_id.fit_machine(gram, signs)
    answers = gram @ found
    loss = np.maximum(1 - signs * answers, 0)
    primal = 0.5 * found @ gram @ found + language_id.SOFTNESS * (loss**2).sum()
    alpha = found * signs
    dual = alpha.sum() - 0.5 * found @ gram @ found - (alpha**2).sum() / (4 * language_id.SOFTNESS)
    assert alpha.min() >= 0 and primal - dual < 1e-2 * primal


def test_families_hold_related_languages(spark):
    rng = random.Random(4)
    syllables = {
        "aa": "ka ta ma na ra", "ab": "ka ta ma na ro", "ba": "xyl qwe zzu plo kri", "bb": "xyl qwe zzu plo kru",
    }
    say = lambda lang, n: " ".join("".join(rng.choices(syllables[lang].split(), k=3)) for _ in range(n))
    rows = [(i, say(lang, 20), lang, "own", 1) for i, lang in enumerate(sorted(syllables) * 40)]
    # One text fills much of the table: it is learnt from once.
    rows += [(1000 + i, rows[0][1], "aa", "own", 1) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit_model(df)
    assert model.families == [[0, 1], [2, 3]] and model.pairs == [(0, 1), (2, 3)]
    unseen = spark.createDataFrame([(i, say(lang, 30), lang, "own", 1) for i, lang in enumerate(sorted(syllables) * 10)], DOCS)
    found = language_id.predict_language(unseen, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 38
    assert all(0 <= r.score <= 1 and r.bucket == 1 for r in found)
    assert language_id.fit_model(df, sample_rows=8).languages == sorted(syllables)
    assert language_id.fit_model(df, languages=1).languages == ["aa"]


def test_odd_rows(spark):
    odd = [(1, None, "en", "x", 1), (2, "", "en", "x", 1), (3, "123 !?", "en", "x", 1), (None, "words here", "de", "x", 1),
           (5, "the word " * 300_000, None, "x", 1), (6, "é", None, "x", 1), (6, "é", None, "x", 1)]
    df = spark.createDataFrame(odd, DOCS)
    assert language_id.fit_model(df) is None
    assert {r.lang_pred for r in language_id.predict_language(df, None).collect()} == {"und"}
    one = language_id.fit_model(spark.createDataFrame([(i, f"some text {i}", "en", "x", 1) for i in range(9)], DOCS))
    rows = language_id.predict_language(df, one).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "en", "en"]
    assert [r.score for r in rows[:4]] == [0, 0, 0, 1] and rows[5] == rows[6]
    assert language_id.predict_language(df.limit(0), one).count() == 0
    assert language_id.fit_model(df.limit(0)) is None
