"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record is a JSON object in one of several layouts.  The paths of its fields, nested
ones included, are sorted and hashed; the hash selects a declared mapping, and the
mapping turns the record into canonical turns ``(role, text)``.  Turns become one text:

    <turn ROLE>            the role, percent-encoded
    TEXT</turn>

A ``<turn`` or ``</turn`` inside a text gets a backslash after its ``<`` (one more if there
are some already), so marks cannot be confused with text and reading back is exact.  The
text is kept in segments, each with a flag for the loss mask; the texts of assistant turns
are under the mask, marks never are.

Cases: a null or malformed record and one in an unknown layout have a null ``layout`` and
no turns; a null text or role is empty; empty lists give no turns; other columns of the
input pass through, a column named like a result is replaced; an empty table gives no rows;
strings of a record may have any length that Java holds (2^31 - 1 characters).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: The parser's default would give nulls for records with a string of more than 20,000,000 characters.
WHOLE = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class ListLayout:
    """Turns in the list ``field``, each an object with a role and a text."""

    name: str
    field: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)
    extra: tuple[str, ...] = ()

    def shapes(self):
        both = f"{self.field}[].{self.role}", f"{self.field}[].{self.text}"
        yield from ((frozenset(both), ()), (frozenset({f"{self.field}[]"}), ()))


@dataclass(frozen=True)
class FieldLayout:
    """Turns in single fields: ``(role, fields)`` in order; several fields join to one text."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    def fields(self):
        return [f for _, fields in self.turns for f in fields]

    def shapes(self):
        yield frozenset(f for f in self.fields() if f not in self.optional), self.optional


LAYOUTS = (
    ListLayout("messages", "messages", "role", "content"),
    ListLayout(
        "conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}
    ),
    FieldLayout(
        "prompt_response",
        (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
        ("system",),
    ),
    FieldLayout("prompt_completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    FieldLayout(
        "instruction",
        (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        ("system", "input"),
    ),
)

#: Fields that say nothing about the turns and take no part in the fingerprint.
IGNORED = ("id", "conv_id", "source", "lang")


def _subsets(names: Sequence[str]):
    return chain.from_iterable(combinations(names, n) for n in range(len(names) + 1))


def _digest(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.sort_array(paths), "\n"))


def _known(layout) -> list[Column]:
    """The fingerprints of a layout, with and without each optional field."""
    return [
        _digest(F.array(*[F.lit(p) for p in sorted(required | set(some))]))
        for required, optional in layout.shapes()
        for some in _subsets(optional)
    ]


def _schema(layouts) -> str:
    kinds: dict[str, str] = {}
    for layout in layouts:
        if isinstance(layout, ListLayout):
            kinds[layout.field] = "array<map<string,string>>"
        else:
            kinds |= {f: "string" for f in layout.fields() if f not in kinds}
    return ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())


def _after(prefix: str):
    return lambda name: F.concat(F.lit(prefix), name)


def field_paths(payload: Column, parsed: Column, layouts=LAYOUTS, ignored=IGNORED) -> Column:
    """Paths of all fields: plain names, and ``list[].name`` for the fields of listed objects."""
    lists = list(dict.fromkeys(x.field for x in layouts if isinstance(x, ListLayout)))
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    paths = [F.filter(keys, lambda k: ~k.isin([*lists, *ignored]))]
    for name in lists:
        items = parsed[name]
        inner = F.array_distinct(F.flatten(F.transform(items, lambda m: F.map_keys(m))))
        nested = F.transform(inner, _after(f"{name}[]."))
        nested = F.when(F.size(items) == 0, F.array(F.lit(f"{name}[]"))).otherwise(
            F.coalesce(nested, F.array(F.lit(f"{name}[]?")))
        )
        present = F.array_contains(keys, name)
        paths.append(
            F.when(items.isNotNull(), nested)
            .when(present, F.array(F.lit(name)))
            .otherwise(F.array().cast("array<string>"))
        )
    return F.concat(*paths)


def _turns(layout, parsed: Column) -> Column:
    if isinstance(layout, ListLayout):

        def turn(m: Column) -> Column:
            role = F.coalesce(m[layout.role], F.lit(""))
            named = role
            for given, canonical in layout.roles.items():
                named = F.when(role == given, F.lit(canonical)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))

        return F.transform(parsed[layout.field], turn).cast(TURNS)
    turns = []
    for role, fields in layout.turns:
        # An optional field that is missing or empty adds nothing, not even a turn.
        texts = [
            F.when(parsed[f] != "", parsed[f]) if f in layout.optional else F.coalesce(parsed[f], F.lit(""))
            for f in fields
        ]
        text = F.array_join(F.array(*texts), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        if all(f in layout.optional for f in fields):
            turn = F.when(F.coalesce(*texts).isNotNull(), turn)
        turns.append(turn)
    return F.array_compact(F.array(*turns)).cast(TURNS)


def canonical_turns(
    records: DataFrame, payload: str = "payload", layouts=LAYOUTS, ignored: Sequence[str] = IGNORED
) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns`` to records with a JSON column."""
    record = F.col(payload)
    rows = records.withColumn("__parsed", F.from_json(record, _schema(layouts), WHOLE))
    parsed = F.col("__parsed")
    rows = rows.withColumn("fingerprint", _digest(field_paths(record, parsed, layouts, ignored)))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in reversed(layouts):
        known = F.col("fingerprint").isin(*_known(layout))
        name = F.when(known, F.lit(layout.name)).otherwise(name)
        turns = F.when(known, _turns(layout, parsed)).otherwise(turns)
    return rows.withColumn("layout", name).withColumn("turns", turns).drop("__parsed")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\(/?turn)", r"<$1$2")


def render(rows: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add ``segments`` (text and loss flag) and ``formatted`` (their texts as one) from ``turns``."""

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit("<turn "), F.url_encode(t["role"]), F.lit(">\n"))
        tail = F.lit("</turn>\n")
        taught = F.array(piece(head, False), piece(escape(t["text"]), True), piece(tail, False))
        given = F.array(piece(F.concat(head, escape(t["text"]), tail), False))
        return F.when(t["role"].isin(*loss_roles), taught).otherwise(given)

    rows = rows.withColumn("segments", F.flatten(F.transform("turns", segments)))
    return rows.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    tail = len("</turn>\n")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, ">\n", 1)
        begin = F.length(role) + 3
        body = F.substring(part, begin, F.length(part) - begin + 1 - tail)
        return F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text"))

    parts = F.split(formatted, "<turn ")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    taught = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(taught, lambda s: unescape(s["text"])), "")


def format_chats(
    records: DataFrame,
    payload: str = "payload",
    layouts=LAYOUTS,
    ignored: Sequence[str] = IGNORED,
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """``canonical_turns`` and ``render`` in one step."""
    return render(canonical_turns(records, payload, layouts, ignored), loss_roles)


def turns_to_records(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Conversations of one row per turn as records ``conv_id, payload`` in the layout that fits.

    Turns stand by turn number (null first), ties by role and text.  A conversation of
    one question and answer becomes a prompt and a response, one of the three common
    roles a list of ``from`` and ``value``, any other a list of messages.
    """
    turns = F.sort_array(
        F.collect_list(
            F.struct(
                F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**63))).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            )
        )
    )
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(turns.alias("__turns"))
    t = F.col("__turns")
    pair = (
        (F.size(t) == 2)
        & F.get(t, F.lit(0))["role"].eqNullSafe("user")
        & F.get(t, F.lit(1))["role"].eqNullSafe("assistant")
    )
    common = F.forall(t, lambda x: x["role"].isin("user", "assistant", "system"))
    prompt = F.to_json(
        F.struct(F.get(t, F.lit(0))["text"].alias("prompt"), F.get(t, F.lit(1))["text"].alias("response"))
    )

    def said(x: Column) -> Column:
        who = F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
        return F.struct(who.alias("from"), x["text"].alias("value"))

    def message(x: Column) -> Column:
        return F.struct(x["role"].alias("role"), x["text"].alias("content"))

    payload = (
        F.when(pair, prompt)
        .when(common, F.to_json(F.struct(F.transform(t, said).alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.transform(t, message).alias("messages"))))
    )
    return grouped.select("conv_id", payload.alias("payload"))
