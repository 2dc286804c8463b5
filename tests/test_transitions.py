"""Requests that follow each other, against a loop over them."""

from __future__ import annotations

import random

import pytest

from millrace.operators import mutations

REQUESTS = "uuid string, at int, action string, note string"


def looped(requests, states, rules):
    now, out = dict(states), []
    for uuid, at, action, note in sorted(requests, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or "", r[3])):
        prior = now.get(uuid)
        needed, after = rules.get(action, (None, None))
        applies = needed is not None and prior == needed
        refused = action == "rm" and not applies
        if applies:
            now[uuid] = after
        out.append((uuid, at, action, note, not refused, mutations.REFUSAL if refused else after if applies else "running", now.get(uuid)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("turns", [256, 2, 3])
def test_requests_see_what_those_before_them_did(spark, monkeypatch, turns):
    monkeypatch.setattr(mutations, "TURNS", turns)
    rng = random.Random(2)
    rules = mutations.TRANSITIONS | {"start": ("stopped", "running")}
    requests = [
        (rng.choice(["hot", "hot", "hot", "a", "b", "c", "unknown", None]), rng.randrange(300), rng.choice(["stop", "start", "rm", "snapshot", None]), "n")
        for _ in range(400)
    ]
    requests = [r if rng.random() < 0.9 or r[2] != "rm" else (*r[:2], "stop", "n") for r in requests]
    states = [("hot", "running"), ("a", "stopped"), ("b", "removed"), ("c", "odd"), (None, "running"), ("idle", "running")]
    done = mutations.transitions_in_turn(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(states, "uuid string, status string"),
        "uuid", ["at", "action"], rules,
    )
    assert done.columns == ["uuid", "at", "action", "note", "ok", "msg", "status"]
    assert sorted(map(tuple, done.collect()), key=repr) == looped(requests, states, rules)


def test_stop_then_remove(spark):
    requests = spark.createDataFrame([("s", 1, "rm", ""), ("s", 2, "stop", ""), ("s", 3, "rm", "")], REQUESTS)
    states = spark.createDataFrame([("s", "running")], "uuid string, status string")
    rows = mutations.transitions_in_turn(requests, states, "uuid", ["at"]).orderBy("at").collect()
    assert [(r.ok, r.msg, r.status) for r in rows] == [
        (False, mutations.REFUSAL, "running"), (True, "stopped", "stopped"), (True, "removed", "removed"),
    ]
    assert mutations.transitions_in_turn(requests.limit(0), states, "uuid", ["at"]).count() == 0
