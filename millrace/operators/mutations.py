"""Changes to keyed tables: a base and a change table in, the next version out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.keys import key_set
from millrace.operators.numbering import number_rows
from millrace.scratch import persist_table

# Which state an action needs, the state it leads to, and its refusal.
TRANSITIONS = {"stop": ("running", "stopped"), "rm": ("stopped", "removed")}
IDLE_MESSAGE = "running"
REFUSED_ACTION = "rm"
REFUSAL = "Stack is running. Please stop first"


def upsert_by_key(
    base: DataFrame, changes: DataFrame, key: Sequence[str], seq: Sequence[str]
) -> DataFrame:
    """Insert or overwrite whole rows; the change that is last in ``seq`` wins.

    Only the winning change of a key leaves each task, so a key with very many changes
    does not gather in one place.
    """
    last = newest_by_key(changes, key, seq)
    kept = base.join(key_set(changes, key), list(key), "left_anti")
    return kept.select(*base.columns).unionByName(last.select(*base.columns))


def newest_by_key(changes: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The change of each key that is last in ``seq``."""
    newest = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in seq])
    return changes.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def set_fields(
    base: DataFrame,
    changes: DataFrame,
    key: str,
    fields: Sequence[str],
    seq: str,
    upsert: bool = True,
) -> DataFrame:
    """Overwrite only the supplied fields of a row; an unknown key is inserted if ``upsert``.

    In ``changes`` each field is a one-field struct: null means "not supplied", a struct
    that holds a null means "set to null".  Several changes of a key apply in ``seq`` order.
    """
    latest = changes.groupBy(key).agg(
        *[
            F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(seq)))
            .alias(f"__{f}")
            for f in fields
        ]
    )
    joined = base.join(latest, key, "full" if upsert else "left")

    def current(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        change = F.col(f"__{name}")
        inner = changes.schema[name].dataType.fieldNames()[0]
        return F.when(change.isNotNull(), change[inner]).otherwise(F.col(name)).alias(name)

    return joined.select(*[current(c) for c in base.columns])


def replace_rows(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Delete the rows of the new keys, then insert the new rows."""
    kept = base.join(key_set(new, key), list(key), "left_anti")
    return kept.select(*base.columns).unionByName(new)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Remove the rows that meet the predicate; an unknown outcome keeps the row."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def guarded_transition(requests: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """``key, action, ok, msg, status``: apply an action only from the state it needs.

    Removing something that is not stopped is refused; stopping something that does not
    run is accepted and changes nothing, as is any other action.  All requests are judged on
    the given states; ``transitions_in_turn`` lets each see what those before it did.
    """
    found = requests.join(states.select(key, F.col("status").alias("__prior")), key, "left")
    return found.select(key, "action", *_judged(F.col("__prior"), TRANSITIONS))


def _judged(prior: Column, transitions: Mapping[str, tuple[str, str]]) -> list[Column]:
    action, applies, target = F.col("action"), F.lit(False), F.lit(None).cast("string")
    for name, (needed, after) in transitions.items():
        fits = (action == name) & prior.eqNullSafe(F.lit(needed))
        applies = applies | fits
        target = F.when(fits, F.lit(after)).otherwise(target)
    refused = F.coalesce((action == REFUSED_ACTION) & ~applies, F.lit(False))
    return [
        (~refused).alias("ok"),
        F.when(refused, REFUSAL).when(applies, target).otherwise(IDLE_MESSAGE).alias("msg"),
        F.coalesce(target, prior).alias("status"),
    ]


TURNS = 256  # requests, or groups of them, whose effects are composed in one row


def transitions_in_turn(
    requests: DataFrame,
    states: DataFrame,
    key: str,
    seq: Sequence[str],
    transitions: Mapping[str, tuple[str, str]] = TRANSITIONS,
) -> DataFrame:
    """All columns of ``requests`` with ``ok, msg, status``, each judged on what those before it left.

    Requests of a key follow ``seq``, then the whole row; a key without a state has a null one.

    A request maps states to states, and such maps compose: those of ``TURNS`` neighbouring
    requests become one, those of ``TURNS`` neighbouring groups one again, until a key has few; then the
    states go down the same way.  So the requests of a hot key are spread over all tasks.  The requests stay
    in their groups meanwhile, and equal ones may take any order, so neither is joined or counted.
    """
    names = list(dict.fromkeys(s for pair in transitions.values() for s in pair))

    def leads_to(state: str) -> Column:
        moves = [F.when(F.col("action") == a, after) for a, (needed, after) in transitions.items() if needed == state]
        return F.coalesce(*moves, F.lit(state))

    effect = F.array(*[leads_to(s) for s in names])
    order = [key, *seq, *requests.columns, "__tie"]
    placed = number_rows(requests.withColumn("__tie", F.monotonically_increasing_id()), order, "__place", unique=True)
    turns = placed.select(
        F.col(key).alias("k"), F.col("__place").alias("at"), effect.alias("effect"), F.struct(*requests.columns).alias("own")
    )
    start = states.select(F.col(key).alias("k"), F.col("status").alias("state"))
    judged = _states_before(turns, start, names).select("own.*", F.col("state").alias("__state"))
    return judged.select(*requests.columns, *_judged(F.col("__state"), transitions))


def _states_before(turns: DataFrame, start: DataFrame, names: Sequence[str]) -> DataFrame:
    """``k, at, own, state``: the state before each of ``k, at, effect, own``, from the states ``k, state`` of the keys.

    An effect has the state that each of ``names`` leads to; other states stay what they are.  The places of a
    key follow each other, so a group that ends on neither edge of its ``TURNS`` places is all of its key.
    """
    up = F.expr(f"at div {TURNS}").alias("up")
    siblings = F.sort_array(F.collect_list(F.struct("at", "effect", "own"))).alias("turns")
    first, last = F.col("turns")[0]["at"], F.element_at("turns", -1)["at"]
    goes_on = ((first > 0) & (first % TURNS == 0)) | (last % TURNS == TURNS - 1)
    groups = persist_table(turns.groupBy("k", up).agg(siblings).withColumn("goes_on", goes_on), "turns")

    def after(state: Column, turn: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, names)), state)
        return F.coalesce(F.get(turn["effect"], place.cast("int") - 1), state)

    known = start.withColumnRenamed("k", "__k")
    whole_keys, cut = groups.filter("NOT goes_on"), groups.filter("goes_on")
    begun = whole_keys.join(known, F.col("k").eqNullSafe(F.col("__k")), "left").select("k", "turns", "state")
    if not cut.isEmpty():
        whole = F.array(*[F.aggregate("turns", F.lit(s), after) for s in names])
        parents = cut.select("k", F.col("up").alias("at"), whole.alias("effect"), F.lit(None).cast("int").alias("own"))
        before = _states_before(parents, start, names).select(F.col("k").alias("__k"), F.col("at").alias("up"), "state")
        later = cut.join(before.withColumnRenamed("up", "__up"), (F.col("up") == F.col("__up")) & F.col("k").eqNullSafe(F.col("__k")))
        begun = begun.unionByName(later.select("k", "turns", "state"))
    walked = F.aggregate(
        "turns",
        F.struct(F.col("state").alias("now"), F.array().cast("array<string>").alias("seen")),
        lambda acc, turn: F.struct(
            after(acc["now"], turn).alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen")
        ),
        lambda acc: acc["seen"],
    )
    begun = begun.withColumn("seen", walked)
    rows = F.transform("turns", lambda turn, i: F.struct(turn["at"].alias("at"), turn["own"].alias("own"), F.get("seen", i).alias("state")))
    return begun.select("k", F.inline(rows))


def increment_counter(
    base: DataFrame, events: DataFrame, key: str, counter: str, latest: str, event_id: str, ts: str
) -> DataFrame:
    """Add the number of events to a counter and stamp the id of the latest one."""
    order = F.struct(ts, event_id)
    seen = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(event_id, order).alias("__last")
    )
    return base.join(seen, key, "left").select(
        *[
            (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col("__n"), F.lit(0))).alias(c)
            if c == counter
            else F.coalesce(F.col("__last"), F.col(c)).alias(c)
            if c == latest
            else F.col(c)
            for c in base.columns
        ]
    )


def delete_row_at(
    df: DataFrame, order: Sequence[Column | str], index: int, unique: bool = False
) -> DataFrame:
    """Remove the row at a 0-based position; a position beyond the end is an error."""
    numbered = number_rows(df, order, "__rn", unique)
    size = numbered.count()
    if not 0 <= index < size:
        raise ValueError(f"no row {index}: the table ends after {size}")
    return numbered.filter(F.col("__rn") != index + 1).drop("__rn")


def clear_rows(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.filter(F.lit(False))


def insert_if_absent(
    rules: DataFrame,
    requests: DataFrame,
    reserved: DataFrame,
    target: Sequence[str],
    source_port: str,
    seq: str,
) -> DataFrame:
    """Every request with ``accepted``: its source port is free and its target has no rule yet.

    Of several requests for one target the first one with a free port is accepted.
    """
    free = requests.join(key_set(reserved, [source_port]), source_port, "left_anti")
    # One row per target from here on, so no step gathers the requests of a popular target.
    first = free.groupBy(*target).agg(F.min(seq).alias(seq))
    winners = first.join(rules.select(*target).distinct(), list(target), "left_anti")
    decided = requests.join(winners.withColumn("__won", F.lit(True)), [*target, seq], "left")
    return decided.select(
        *requests.columns, F.coalesce(F.col("__won"), F.lit(False)).alias("accepted")
    )
