"""One JSON document read by byte ranges: the same elements as a parser finds, wherever the cuts fall."""

from __future__ import annotations

import json
import random

import pytest

from millrace.sources import graph_json, large_json


def test_states_compose_over_any_cut():
    rng = random.Random(1)
    for _ in range(300):
        doc = {"".join(rng.choices('a"\\{[]}é', k=4)): ["".join(rng.choices('x"\\\\[{}]\n', k=rng.randrange(9))) for _ in range(4)], "n": [[{}], 1]}
        data = json.dumps(doc, ensure_ascii=False).encode()
        whole = large_json.marks_of(data, large_json.OUTSIDE)
        assert whole.end == large_json.OUTSIDE and whole.steps.sum() == 0
        cut = rng.randrange(len(data) + 1)
        first = large_json.marks_of(data[:cut], large_json.OUTSIDE)
        second = large_json.marks_of(data[cut:], first.end)
        assert [*first.places, *(second.places + cut)] == list(whole.places) and second.end == whole.end


@pytest.mark.parametrize("chunk", [7, 64, 1000, 1 << 20])
def test_elements_of_documents(spark, tmp_path, chunk):
    rng = random.Random(2)
    want = []
    for f in range(3 if chunk > 7 else 1):
        graph = {"mode": 'od"d [', "vertices": [], "edges": [], "none": [], "more \"[{": []}
        for name in ("vertices", "edges", "more \"[{"):
            for i in range(rng.randrange(30)):
                graph[name].append({"_id": i, "name": "".join(rng.choices('a"\\[]{}é,:', k=rng.randrange(20))), "deep": [{"k": [[]]}, i]})
            graph[name] += [5, "text {", [{"not": "an element"}]]
        want += [(f"d/{f}.json", n, x) for n, xs in graph.items() if isinstance(xs, list) for x in xs if isinstance(x, dict)]
        file = tmp_path / "d" / f"{f}.json"
        file.parent.mkdir(exist_ok=True)
        file.write_text(json.dumps({"other": {"vertices": 1}, "graph": graph, "tail": [1, [2]]}, indent=f or None, ensure_ascii=False))
    found = large_json.array_elements(spark, str(tmp_path), 3, chunk).collect()
    key = lambda r: json.dumps(r)
    assert sorted(((r.file, r.array, json.loads(r.element)) for r in found), key=key) == sorted(want, key=key)


def test_graph_tables(spark, tmp_path, rows):
    doc = {"graph": {"mode": "NORMAL", "vertices": [{"name": "a", "type": "t", "_id": 1, "_type": "vertex"}],
                     "edges": [{"_id": 7, "_type": "edge", "_outV": 1, "_inV": 2, "_label": "l"}]}}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    (tmp_path / "empty.json").write_text("")
    v, e = graph_json.scan_large_graph(spark, str(tmp_path), 16)
    assert rows(v) == [("a", "t", 1, "vertex")] and rows(e) == [(7, "edge", 1, 2, "l")]
    (tmp_path / "cut.json").write_text('{"graph": {"vertices": [{"name": "a')
    with pytest.raises(Exception, match="no whole JSON document"):
        large_json.array_elements(spark, str(tmp_path), 3, 16).collect()
