"""The operators in DataFrame operations only, against brute force and on odd inputs."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, mixing, plans, quality_rules
from tests.oracle import compare, type_differences

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


@pytest.mark.parametrize("key", sorted(plans.ORACLES))
def test_matches_sql(key, spark, sf_dir, duck):
    df = plans.QUERIES[key](spark, sf_dir)
    assert type_differences(df, duck, plans.ORACLES[key]) == {}
    assert compare(df, duck, plans.ORACLES[key])[1] is None


@pytest.mark.parametrize("key", ["op2_mix_sources", "op8_format_chats", "op9_quality_rules"])
def test_runs_no_python(key, spark, sf_dir):
    plan = plans.QUERIES[key](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map)", plan)


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(1.2) * 5), "en", rng.choice("aaab"), 1) for i in range(600)]
    rows += [(None, None, None, None, None), (7, "", None, None, 0), (7, "x y", "en", None, 0), (7, "x y", "en", None, 0)]
    rows += [(900, "   ", "en", "zero", 3)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source], most[r.source] = r.target, max(most[r.source], r.size)
        assert 0 <= r.copies <= 3
    total = sum(sizes.values())
    assert sum(target.values()) == pytest.approx(total)
    for source, size in sizes.items():
        assert target[source] <= 3 * size + 1e-6
        assert abs(taken[source] - target[source]) <= most[source] + 1e-6
    # Weights 5, 2, 1, 5 for a, b, zero and null; the small ones stop at three times their size.
    assert target["zero"] == 0 and target[None] == 3 * sizes[None]
    again = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_is_emitted(spark):
    rows = [(i % 50, f"t{i % 50} x", "en", "ab"[i % 2], 1) for i in range(60)] + [(None, "n n n", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("copy", F.lit("old"))
    wanted = mixing.mix_sources(df).agg(F.sum("copies")).first()[0]
    out = mixing.emit_mix(df)
    assert out.columns == df.columns and out.count() == wanted
    assert {r["size"] for r in out.collect()} == {"own"}
    assert mixing.emit_mix(df.limit(0)).count() == 0
    assert mixing.mix_sources(df.limit(0)).count() == 0


def base_measures(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "é ü #*", "a b c d e f g h " * 6, "x\ny\nx\n\nx", "|" * 50 + " <a>"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["l 1", "l 2", " "]) for _ in range(9)), "word " * 30_000]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.report_rules(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.report_rules(df.limit(0)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark):
    texts = ["fine words here and there " + " ".join(f"w{i}" for i in range(30)), "BAD!! " * 40, "a*** b### " * 30, None]
    df = quality_rules.with_words(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    rules = [*quality_rules.BASE_RULES, *quality_rules.RULES]
    verdicts = [
        {r.i: r.rejected_by is None for r in quality_rules.cascade(df, order).collect()}
        for order in (rules, rules[::-1])
    ]
    assert verdicts[0] == verdicts[1] == {0: True, 1: False, 2: False, 3: False}
    kept = quality_rules.apply_rules(df.drop("__text", "__words"), sample_rows=3)
    assert kept.columns == ["i", "text", "rejected_by", "kept"]
    assert {r.i: r.kept for r in kept.collect()} == verdicts[0]
    worth = [quality_rules.Estimate(rules[0], 2.0, 0.5), quality_rules.Estimate(rules[1], 0.1, 0.4)]
    assert quality_rules.order_rules(worth) == [rules[1], rules[0]]


TURNS = [("user", "a <turn x> </turn> \\<turn"), ("assistant", "<\\\\turn </turn>\n<turn"), ("tool>\n", "")]


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": r, "content": t} for r, t in TURNS]}, "messages", TURNS),
        ({"conversations": [{"value": "q", "from": "human"}, {"from": "gpt", "value": None}]}, "conversations",
         [("user", "q"), ("assistant", "")]),
        ({"prompt": "[{\"a\": 1}]", "response": "r", "id": 5}, "prompt_response",
         [("user", "[{\"a\": 1}]"), ("assistant", "r")]),
        ({"response": "r", "system": "s", "prompt": "p"}, "prompt_response",
         [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"messages": []}, "messages", []),
        ({"messages": "text"}, None, []),
        ({"prompt": "p"}, None, []),
        ([1], None, []),
    ],
)
def test_chat_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record), "own")], "payload string, segments string")
    r = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).first()
    assert r.layout == layout
    assert [tuple(t) for t in r.turns] == turns == [tuple(t) for t in r.back]
    assert "".join(s["text"] for s in r.segments) == r.formatted
    taught = chat.format_chats(df).select(chat.masked_text(F.col("segments"))).first()[0]
    assert taught == "".join(t for role, t in turns if role == "assistant")


def test_odd_records(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ("{}",)], "payload string")
    rows = chat.format_chats(df).collect()
    assert [(r.layout, r.turns, r.formatted) for r in rows] == [(None, [], "")] * 4


def test_conversations_become_records(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None),
            (None, 0, "user", "x" * 100_000), (3, 0, "user", "q"), (3, 1, "assistant", "r")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(chat.turns_to_records(df))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()}
    assert got[1] == [("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[2] == [("", "")] and got[None] == [("user", "x" * 100_000)]
    assert got[3] == [("user", "q"), ("assistant", "r")]
    assert len({r.layout for r in out.collect()}) == 3
    assert chat.turns_to_records(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() == out.limit(1).select(F.sha2(F.lit(""), 256)).first()[0]


@pytest.mark.parametrize("others", [1, 2])
def test_turns_above_the_parsers_default_length(spark, others):
    """One turn above 20,000,000 characters, as a prompt with its response and in a list."""
    n = 20_000_100
    rows = spark.range(others + 1).select(
        F.lit(1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") == 0, F.repeat(F.lit("x"), n)).otherwise("short").alias("text"),
    )
    out = chat.format_chats(chat.turns_to_records(rows)).select(
        "layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n"), F.length("formatted").alias("all")
    )
    row = out.first()
    assert row.layout == ("prompt_response" if others == 1 else "conversations")
    assert row.n == [n] + [5] * others and row["all"] > n


def test_many_equal_rows_are_emitted_as_often_as_sampled(spark):
    rows = [(None, "", "a", i % 3) for i in range(4000)] + [(i, "some words here", "b", 0) for i in range(50)] + [(7, "x " * 50_000, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").repartition(5)
    sizes = mixing.mix_sources(df)
    wanted = {(r.doc_id, r.source): r.n for r in sizes.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    first, second = (
        sorted(map(tuple, mixing.emit_mix(d).drop("text").collect()), key=repr) for d in (df, df.repartition(9))
    )
    assert first == second
    got = Counter((r[0], r[1]) for r in first)
    assert got == {k: n for k, n in wanted.items() if n}
    assert mixing.emit_mix(df.limit(0)).count() == 0
