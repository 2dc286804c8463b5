"""Repair of damaged conversations as lightest derivations, found by Knuth's agenda.

A repair reads the turns of a conversation in order and edits them so that the role initials form
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2), Insert an empty turn (5);
a truncated turn that stays costs 5 more, blank and repeated turns must be deleted.  An item
says that the turns from place ``i`` on can be read from automaton state ``p``; a deduction
adds one edit in front of such an item, or joins the derivation of a stretch of turns with
that of the rest.  Weights are (cost, turns read, audit), compared in this order.  All
deductions are monotone, and superior as an edit without a cost reads a turn, so the agenda
pops each item at its lightest weight and ends when the goal item is popped.

Turns are numbered over the whole table and cut into blocks of ``BLOCK`` places, so no task
gets a conversation whole.  A block solves the conversations that lie inside it; of one that
reaches over a border it derives the lightest weight from every state to every state, and
these stretches are joined by the same agenda, ``FAN_IN`` at a time.

Cases: null roles and texts count as one space (so the text is blank); a null conversation id
is one conversation; turns without a number come first, equal numbers go by role and text, and
repeated rows beside each other; texts of any length are only measured, never sent to Python;
an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.keys import salted_join, spread
from millrace.operators.numbering import number_rows
from millrace.scratch import persist_table

BLOCK = 1024  # turns that one task solves together
FAN_IN = 64  # stretches joined at a time
SALT = 16

# Costs of the edits, and the white space of the texts.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"

# The automaton of (s?(ua)+)?: states are 0 start, 1 after s, 2 after u, 3 after a.
STATES, START, ACCEPTING = range(4), 0, (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
INTO = {q: [(p, x) for (p, x), to in STEPS.items() if to == q] for q in STATES}
ROLES = {"u": "user", "a": "assistant"}
GONE = "-"  # kind of a turn that must be deleted; others are the initial, upper case if truncated

Weight = tuple[int, int, str]
Derived = tuple[Weight, tuple]


def lightest(
    axioms: Iterable[Derived], rules: Callable[[tuple, dict], Iterable[Derived]], goals: Iterable[tuple]
) -> dict[tuple, Weight]:
    """Pop items by weight until the ``goals`` are final (or nothing is left); the final weights.

    ``rules(item, final)`` gives what follows from an item just made final and those before.
    """
    agenda, final, wanted = list(axioms), {}, set(goals)
    heapq.heapify(agenda)
    while agenda and wanted:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        wanted.discard(item)
        for derived in rules(item, final):
            if derived[1] not in final:
                heapq.heappush(agenda, derived)
    return final


def _edits(kinds: str) -> Callable[[tuple, dict], Iterator[Derived]]:
    """Deductions that put one edit in front of an item (place, state)."""

    def rules(item: tuple, final: dict) -> Iterator[Derived]:
        (i, q), (cost, read, audit) = item, final[item]
        for p, letter in INTO[q]:
            if letter in ROLES:
                yield (cost + INSERT, read, "I" + audit), (i, p)
        if i == 0:
            return
        kind = kinds[i - 1]
        yield (cost + DELETE, read + 1, "D" + audit), (i - 1, q)
        if kind == GONE:
            return
        extra = TRUNCATED if kind.isupper() else 0
        for p, letter in INTO[q]:
            if letter == kind.lower():
                yield (cost + extra + KEEP, read + 1, "K" + audit), (i - 1, p)
            elif letter in ROLES:
                yield (cost + extra + REROLE, read + 1, "R" + audit), (i - 1, p)

    return rules


def _solve(kinds: str) -> tuple[int, str]:
    ends = [((0, 0, ""), (len(kinds), q)) for q in ACCEPTING]
    cost, _, audit = lightest(ends, _edits(kinds), [(0, START)])[0, START]
    return cost, audit


_remembered = lru_cache(maxsize=20_000)(_solve)


def solve_whole(kinds: str) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation; short ones are remembered."""
    return _remembered(kinds) if len(kinds) <= 32 else _solve(kinds)


class Path(NamedTuple):
    """The lightest way from one state to another over a stretch, and its pieces by block."""

    enter: int
    leave: int
    cost: int
    audit: str
    lengths: list[int]
    enters: list[int]


def _path(p: dict) -> Path:
    return Path(**p | {"lengths": list(p["lengths"]), "enters": list(p["enters"])})


def solve_stretch(kinds: str) -> list[Path]:
    """The lightest ways over a stretch of turns between all pairs of states."""
    found = []
    for q in STATES:
        final = lightest([((0, 0, ""), (len(kinds), q))], _edits(kinds), [(0, p) for p in STATES])
        for p in STATES:
            if (0, p) in final:
                cost, _, audit = final[0, p]
                found.append(Path(p, q, cost, audit, [len(audit)], [p]))
    return found


def join_stretches(stretches: list[tuple[int, list[Path]]]) -> list[Path]:
    """The lightest ways over stretches that follow each other; each is (turns, paths)."""
    by_leave = [{q: [x for x in paths if x.leave == q] for q in STATES} for _, paths in stretches]
    n, found = len(stretches), []
    for q in STATES:
        via: dict[tuple, Path] = {}

        def rules(item: tuple, final: dict) -> Iterator[Derived]:
            # A final rest and the final derivation of a stretch that leads to it give a longer rest.
            (k, at), (cost, read, audit) = item, final[item]
            for path in by_leave[k - 1][at] if k else ():
                weight = (path.cost + cost, stretches[k - 1][0] + read, path.audit + audit)
                before = (k - 1, path.enter)
                if before not in final and (before not in best or weight < best[before]):
                    best[before], via[before] = weight, path
                    yield weight, before

        best: dict[tuple, Weight] = {}
        final = lightest([((0, 0, ""), (n, q))], rules, [(0, p) for p in STATES])
        for p in STATES:
            if (0, p) in final:
                cost, _, audit = final[0, p]
                lengths, enters, at = [], [], p
                for k in range(n):
                    path = via[k, at]
                    lengths += path.lengths
                    enters += path.enters
                    at = path.leave
                found.append(Path(p, q, cost, audit, lengths, enters))
    return found


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


_PATHS = "array<struct<enter:int,leave:int,cost:bigint,audit:string,lengths:array<int>,enters:array<int>>>"
_STRETCH = f"key string, low bigint, turns bigint, first string, last string, illegal bigint, inside boolean, paths {_PATHS}"
_COLUMNS = ["key", "low", "turns", "first", "last", "illegal", "inside", "paths"]


def _solve_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Solve the conversations of one block of places."""
    rows = rows.sort_values("place")
    out = []
    block = int(rows["block"].iloc[0])
    runs = list(rows.groupby("key", sort=False)[["initial", "kind"]])
    for n, (key, run) in enumerate(runs):
        kinds, initials = "".join(run["kind"]), list(run["initial"])
        inside = 0 < n < len(runs) - 1
        if inside:
            cost, audit = solve_whole(kinds)
            paths = [Path(START, ACCEPTING[-1], cost, audit, [len(audit)], [START])]
        else:
            paths = solve_stretch(kinds)
        out.append((key, block, len(kinds), initials[0], initials[-1], illegal_pairs(initials), inside,
                    [p._asdict() for p in paths]))
    return pd.DataFrame(out, columns=_COLUMNS)


def _join_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Join stretches of one conversation that follow each other."""
    rows = rows.sort_values("low")
    paths = [[_path(p) for p in x] for x in rows["paths"]]
    illegal = int(rows["illegal"].sum()) + sum(
        illegal_pairs([a, b]) for a, b in zip(rows["last"], rows["first"].iloc[1:], strict=False)
    )
    joined = join_stretches(list(zip(map(int, rows["turns"]), paths, strict=True))) if len(rows) > 1 else paths[0]
    head = rows.iloc[0]
    return pd.DataFrame(
        [(head["key"], int(head["low"]), int(rows["turns"].sum()), head["first"], rows["last"].iloc[-1], illegal, False,
          [p._asdict() for p in joined])],
        columns=_COLUMNS,
    )


_WAY = "key string, low bigint, illegal bigint, cost bigint, audit string, pieces array<struct<enter:int,piece:string>>"


def _join_whole(rows: pd.DataFrame) -> pd.DataFrame:
    """The lightest accepted way over a whole conversation, given by stretches, cut by block again."""
    whole = _join_group(rows).iloc[0]
    way = min(
        (_path(p) for p in whole["paths"] if p["enter"] == START and p["leave"] in ACCEPTING),
        key=lambda p: (p.cost, p.audit),
    )
    pieces, at = [], 0
    for size, enter in zip(way.lengths, way.enters, strict=True):
        pieces.append({"enter": int(enter), "piece": way.audit[at : at + size]})
        at += size
    return pd.DataFrame(
        [(whole["key"], whole["low"], whole["illegal"], way.cost, way.audit, pieces)],
        columns=["key", "low", "illegal", "cost", "audit", "pieces"],
    )


def _decode(turns: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """One row for each edit of a block: where it stands and the role it gives."""
    out = []
    ways = {k: (enter, audit) for k, enter, audit in zip(pieces["key"], pieces["enter"], pieces["piece"], strict=True)}
    for key, run in turns.sort_values("place").groupby("key", sort=False)[["place", "initial"]]:
        state, audit = ways[key]
        places, initials, i = list(run["place"]), list(run["initial"]), 0
        for step, edit in enumerate(audit):
            at = places[min(i, len(places) - 1)]
            new = None if edit in "KD" else "a" if state == 2 else "u"
            if edit != "D":
                state = STEPS[state, new or initials[i]]
            i += edit != "I"
            out.append((at, step, edit, ROLES.get(new)))
    return pd.DataFrame(out, columns=["place", "step", "edit", "new_role"])


class Repair(NamedTuple):
    report: DataFrame
    """A row for each conversation: its faults, cost and audit."""
    turns: DataFrame
    """The repaired turns in order of ``place``, ``step``, with the edit that made them (K, R or I)."""


def conversation_key(conv_id: Column) -> Column:
    """A text that tells all ids apart, null included."""
    return F.to_json(F.struct(conv_id.alias("id")))


def repair_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Find and apply the cheapest repair of every conversation."""
    said = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    placed = number_rows(said, ["conv_id", "turn", "role", "text"], "place")
    ending = F.rtrim("text", F.lit(SPACE))
    marks = placed.select(
        "place",
        conversation_key(F.col("conv_id")).alias("key"),
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        (ending == "").alias("blank"),
        (~F.substring(ending, -1, 1).isin(".", "!", "?")).alias("open"),
        F.xxhash64("role", "text").alias("h"),
        F.xxhash64(F.lit("again"), "text", "role").alias("g"),
    )
    said_by = ["key", "h", "g"]
    repeated = (
        marks.groupBy(*said_by, spread(said_by))
        .agg(F.min("place").alias("original"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(*said_by, "original")
    )
    again = F.coalesce(F.col("place") > F.col("original"), F.lit(False)) & ~F.col("blank")
    judged = salted_join(marks, repeated, said_by, "left", ["place"], SALT).withColumn("duplicate", again)
    judged = judged.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate"))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    kind = (
        F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), F.upper(known)).otherwise(known)
    )
    block = F.expr(f"(place - 1) div {BLOCK}")
    turns = persist_table(
        judged.select("place", "key", "turn", "initial", "blank", "duplicate", "truncated", kind.alias("kind"), block.alias("block")),
        "turns",
    )

    # A fixed number of partitions: these rows are short, and adaptive execution would merge the work by their bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = turns.select("block", "place", "key", "initial", "kind").repartition(tasks, "block")
    solved = persist_table(slim.groupBy("block").applyInPandas(_solve_block, _STRETCH), "stretches")
    # Only the first and the last conversation of a block can go on in another.
    parts = solved.filter("NOT inside")
    most = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = FAN_IN
    while most > FAN_IN:
        parts = parts.withColumn("up", F.expr(f"low div {width}")).groupBy("key", "up").applyInPandas(_join_group, _STRETCH)
        parts = persist_table(parts, "stretches")
        # Groups begin at multiples of the width, so a run can touch one more than it fills.
        most, width = (most - 2) // FAN_IN + 2, width * FAN_IN
    joined = parts.groupBy("key").applyInPandas(_join_whole, _WAY)
    way = F.element_at("paths", 1)
    alone = solved.filter("inside").select(
        "key", "low", "illegal", way["cost"].alias("cost"), way["audit"].alias("audit"),
        F.array(F.struct(F.lit(START).alias("enter"), way["audit"].alias("piece"))).alias("pieces"),
    )
    ways = persist_table(alone.unionByName(joined), "ways")

    pieces = ways.select("key", "low", F.posexplode("pieces").alias("n", "p")).select(
        "key", (F.col("low") + F.col("n")).alias("block"), "p.*"
    )
    edits = slim.groupBy("block").cogroup(pieces.groupBy("block")).applyInPandas(
        _decode, "place bigint, step int, edit string, new_role string"
    )
    repaired = edits.filter("edit <> 'D'").join(placed, "place").select(
        "conv_id", "place", "step", "edit",
        F.coalesce("new_role", "role").alias("role"),
        F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
    )

    faults = ["blank", "duplicate", "truncated"]
    counts = (
        turns.groupBy("key", "turn")
        .agg(*[F.count_if(F.col(c)).alias(c) for c in faults])
        .groupBy("key")
        .agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            *[F.sum(c).alias(c) for c in faults],
        )
    )
    ids = placed.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    report = ids.join(counts, "key").join(ways, "key").select(
        "conv_id", "gaps", *faults, "illegal", "cost", "audit"
    )
    return Repair(report, repaired)


def digest_turns(turns: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, by ``key``; rows stream through, no text is gathered.

    Such a hash has to read its lines one after the other, so one conversation is one task's work.
    """
    lines = turns.select(
        conversation_key(F.col("conv_id")).alias("key"), "place", "step", F.concat("role", F.lit(":"), "text").alias("line")
    )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, line in zip(batch["key"], batch["line"], strict=True):
                if k == key:
                    state.update(b"\n")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(line.encode())
            yield pd.DataFrame(done, columns=["key", "sha256"])
        if state:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "sha256"])

    ordered = lines.repartition("key").sortWithinPartitions("key", "place", "step").select("key", "line")
    return ordered.mapInPandas(stream, "key string, sha256 string")
