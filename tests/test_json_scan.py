"""Leaves of JSON texts: against a recursive reading, on malformed texts, at any depth."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import maps
from millrace.functions.json_scan import indented, leaves
from millrace.operators import nested


def recursive(doc, into_lists, path=()):
    steps = doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) and into_lists else ()
    if not (isinstance(doc, (dict, list)) and list(steps)):
        yield path, doc
        return
    for step, value in doc.items() if isinstance(doc, dict) else enumerate(doc):
        yield from recursive(value, into_lists, (*path, str(step)))


def random_value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind >= 5:
        keys = rng.sample(["a", "B c", 'q"\\', "é\n", "", "😀"], rng.randrange(5))
        return {k: random_value(rng, depth - 1) for k in keys} if kind > 5 else [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.choice([0, -12, 3.5, 1e300, -2e-7]), rng.choice(["", "x", '{"]', "\\", "tab\t"]), 12345678901234567890][kind]


@pytest.mark.parametrize("into_lists", [False, True])
def test_leaves_against_recursion(into_lists):
    rng = random.Random(1)
    for _ in range(500):
        doc = random_value(rng, 5)
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        got = [(leaf.path, json.loads(leaf.text)) for leaf in leaves(text, into_lists)]
        assert got == list(recursive(doc, into_lists))


def test_malformed_texts_are_refused():
    good = ['{"a": [1, {"b": null}], "c": "\\u00e9"}', "[]", " 1 ", '"x"', "-0.5e+3"]
    for text in good:
        list(leaves(text))
    for text in good:
        for i in range(len(text.strip())):
            cut = text.strip()[:i]
            try:
                json.loads(cut)
            except ValueError:
                with pytest.raises(ValueError):
                    list(leaves(cut))
    for text in ["", "{", '{"a" 1}', '{"a":1,}', "[1,]", "[1 2]", "{1:2}", "nul", "01", "+1", "1.", '"\t"', '"\\x"', "[}", "1 2", "]", "{,}"]:
        with pytest.raises(ValueError):
            list(leaves(text))


def test_top_lists_number_their_items():
    found = list(leaves('[[{"k": [1]}, 5], {"o": {}}, []]', top_lists=True))
    assert [(x.item, x.path, x.text) for x in found] == [
        ((0, 0), ("k",), "[1]"), ((0, 1), (), "5"), ((1,), ("o",), "{}"), ((2,), (), "[]"),
    ]


def chain(depth, leaf='"x"'):
    return '{"a":' * depth + leaf + "}" * depth


def test_deep_documents(spark):
    docs = [(1, chain(500)), (2, chain(20_000)), (3, '{"a": ' + "[" * 5000 + "]" * 5000 + "}"), (4, None), (5, '{"b": "y"}')]
    df = spark.createDataFrame(docs, "id int, doc string")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("\n")
    flat = nested.flatten_to_pairs(df, "id", "doc", "P")
    assert plan(flat) < 12
    got = {(r.id, r.value): len(r.name) for r in flat.collect()}
    assert got == {(1, "x"): len("P") + 499 * 6 + 2, (2, "x"): len("P") + 19_999 * 6 + 2, (5, "y"): 3}

    left = nested.json_leaves(df.filter("id in (1, 5)"), "id", "doc").withColumn("value", F.col("value").cast("string"))
    changes = spark.createDataFrame([(1, chain(500, '{"a": "z", "b": "w"}')), (5, chain(300))], "id int, doc string")
    right = nested.json_leaves(changes, "id", "doc").withColumn("value", F.col("value").cast("string"))
    merged = nested.merge_config(left, right, "id", strict=False)
    assert sorted((r.id, len(r.path), r.value) for r in merged.collect()) == [(1, 501, "w"), (1, 501, "z"), (5, 1, "y"), (5, 300, "x")]
    with pytest.raises(Exception, match="meets a subtree"):
        nested.merge_config(left, right, "id").collect()


def test_keys_of_any_type_and_many_leaves(spark, monkeypatch):
    big = json.dumps({f"k{i}": i for i in range(25_000)})
    df = spark.createDataFrame([(None, '{"a": 1}'), (2**60 + 1, '{"a": [1, 2]}'), (3, big), (3, "{}")], "id bigint, doc string")
    found = nested.json_leaves(df, "id", "doc", into_lists=True)
    assert sorted(map(tuple, found.groupBy("id").count().collect()), key=repr) == [(1152921504606846977, 2), (3, 25_000), (None, 1)]
    assert nested.json_leaves(df.limit(0), "id", "doc").count() == 0
    with pytest.raises(Exception, match="no JSON"):
        nested.json_leaves(spark.createDataFrame([(1, "{oops}")], "id int, doc string"), "id", "doc").collect()


def test_indented_texts():
    rng = random.Random(5)
    for _ in range(500):
        doc = random_value(rng, 5)
        for sort_keys in (True, False):
            want = json.dumps(doc, sort_keys=sort_keys, indent=2, separators=(",", ":"), ensure_ascii=False)
            assert indented(json.dumps(doc, ensure_ascii=False), sort_keys=sort_keys) == want
    assert indented('{"b":1,"a":2,"b":3}') == '{\n  "a":2,\n  "b":3\n}'
    deep = indented(chain(3000))
    assert deep.count("\n") == 6000
    with pytest.raises(ValueError):
        indented("{oops}")


def test_indented_column(spark):
    df = spark.createDataFrame([('{"k": [1, "]"]}',), (None,)], "doc string")
    rows = [r.t for r in df.select(maps.indented_json(F.col("doc"), 1).alias("t")).collect()]
    assert rows == ['{\n "k":[\n  1,\n  "]"\n ]\n}', None]
