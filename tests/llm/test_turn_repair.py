"""Conversation repair against enumerated and left-to-right repairs, with small and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from millrace.llm import plans, turn_repair
from tests.oracle import compare

ROWS = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile("(s?(ua)+)?").fullmatch


def enumerated(kinds):
    """The least (cost, audit) of all repairs with at most two inserted turns in a gap."""
    gaps = [""] + ["".join(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    edits = []
    for kind in kinds:
        stay = 5 if kind.isupper() else 0
        options = [(2, "D", "")]
        if kind != turn_repair.GONE:
            options += [(stay, "K", kind.lower()), (stay + 1, "R", "u"), (stay + 1, "R", "a")]
        edits.append(options)
    found = []
    for chosen in itertools.product(*edits):
        for extra in itertools.product(gaps, repeat=len(kinds) + 1):
            roles = extra[0] + "".join(e[2] + x for e, x in zip(chosen, extra[1:], strict=True))
            if GOOD(roles):
                audit = "I" * len(extra[0]) + "".join(e[1] + "I" * len(x) for e, x in zip(chosen, extra[1:], strict=True))
                found.append((sum(e[0] for e in chosen) + 5 * audit.count("I"), audit))
    return min(found)


def swept(kinds):
    """The same by states from left to right."""
    steps = turn_repair.STEPS

    def inserted(best):
        for _ in range(2):
            for (p, x), q in steps.items():
                if x != "s" and p in best:
                    way = (best[p][0] + 5, best[p][1] + "I")
                    best[q] = min(best.get(q, way), way)
        return best

    best = inserted({0: (0, "")})
    for kind in kinds:
        stay = 5 if kind.isupper() else 0
        new = {p: (c + 2, a + "D") for p, (c, a) in best.items()}
        for (p, x), q in steps.items() if kind != turn_repair.GONE else ():
            if p in best and (x != "s" or kind.lower() == "s"):
                c, a = best[p]
                way = (c + stay, a + "K") if x == kind.lower() else (c + stay + 1, a + "R")
                new[q] = min(new.get(q, way), way)
        best = inserted(new)
    return min(best[q] for q in turn_repair.ACCEPTING if q in best)


def test_agenda_finds_the_least_repair():
    for n in range(3):
        for kinds in itertools.product("suaxUA-", repeat=n):
            assert turn_repair.solve_whole("".join(kinds)) == enumerated(kinds) == swept(kinds)
    rng = random.Random(3)
    for _ in range(200):
        kinds = "".join(rng.choices("suaxSUAX-", k=rng.randrange(60)))
        assert turn_repair.solve_whole(kinds) == swept(kinds)


def test_stretches_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(100):
        parts = ["".join(rng.choices("suuaaxSUAX-", k=rng.randrange(1, 9))) for _ in range(rng.randrange(2, 6))]
        joined = turn_repair.join_stretches([(len(p), turn_repair.solve_stretch(p)) for p in parts])
        ways = [p for p in joined if p.enter == 0 and p.leave in turn_repair.ACCEPTING]
        best = min(ways, key=lambda p: (p.cost, p.audit))
        assert (best.cost, best.audit) == swept("".join(parts))
        assert sum(best.lengths) == len(best.audit) and len(best.enters) == len(parts)


def expected(rows):
    """Report and repaired lines of each conversation, by brute force."""
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ")
                       for c, t, r, x in rows if c == conv))
        kinds, seen, count = "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in said:
            core = text.strip(turn_repair.SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = swept(kinds)
        state, lines, i = 0, [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else said[i][2:]
            new = role if edit == "K" else "assistant" if state == 2 else "user"
            if edit != "D":
                lines.append(f"{new}:{text}")
                state = turn_repair.STEPS[state, new[0]]
            i += edit != "I"
        turns = {t for known, t, _, _ in said if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, _, r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, lines)
    return out


def made(seed, conversations, turns):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(1, turns)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "well", " ", "", None, "Why? \n", "é 😀", f"Told {turn}.", "x" * 3000 + "."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("block,fan_in", [(1024, 64), (4, 2)])
def test_repair_against_brute_force(spark, monkeypatch, block, fan_in):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    monkeypatch.setattr(turn_repair, "FAN_IN", fan_in)
    rows = made(5, 40, 9) + [(99, i, "user" if i % 3 else "assistant", f"Line {i % 40}.") for i in range(90)]
    df = spark.createDataFrame(rows, ROWS)
    repair = turn_repair.repair_turns(df)
    want = expected(rows)
    report = {r.conv_id: r for r in repair.report.collect()}
    lines = {conv: [] for conv in want}
    for r in sorted(repair.turns.collect(), key=lambda r: (r.place, r.step)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    hashes = {r.key: r.sha256 for r in turn_repair.digest_turns(repair.turns).collect()}
    assert report.keys() == want.keys()
    for conv, (*figures, good) in want.items():
        r = report[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == figures
        assert lines[conv] == good
        key = "{}" if conv is None else f'{{"id":{conv}}}'
        assert hashes.get(key) == (hashlib.sha256("\n".join(good).encode()).hexdigest() if good else None)


def test_repair_of_odd_tables(spark):
    empty = turn_repair.repair_turns(spark.createDataFrame([], ROWS))
    assert empty.report.count() == empty.turns.count() == 0
    own = "conv_id string, turn int, role string, text string, place string, key string, block int, kind string"
    rows = [("c", 0, "user", "Hi.", "a", "b", 1, "c"), ("c", 1, "assistant", "long " * 400_000 + "!", "a", "b", 1, "c")]
    repair = turn_repair.repair_turns(spark.createDataFrame(rows, own))
    assert [(r.conv_id, r.cost, r.audit) for r in repair.report.collect()] == [("c", 0, "KK")]
    assert max(len(r.text) for r in repair.turns.collect()) == 2_000_001


def test_query_matches_sql_with_nulls_and_lost_conversations(spark, duck, tmp_path):
    rows = made(7, 60, 8) + [(i, 5, "user", "Alone.") for i in range(1000, 1060)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = plans.QUERIES["op11_repair_conversations"](spark, str(tmp_path))
    assert compare(df, own, plans.ORACLES["op11_repair_conversations"])[1] is None
    assert df.filter("audit = ''").count() > 0
