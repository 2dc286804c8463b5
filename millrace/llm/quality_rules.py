"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule rejects a document on one measure.  A sample of the documents tells what a
rule costs (seconds of a small job that evaluates it alone) and how much it rejects; the
rules then run by falling rejection per cost, and a document that one rule rejects is
not measured by the later ones.  The order changes the work, never the verdict: a
document is kept if no rule rejects it.

Cases: null and empty texts have no words, and all measures are 0; rules that compare
with the number of words reject nothing there (``too_short`` does); equal rows get equal
rows; an empty table gives no rows and rules in the order given; other columns of the
input pass through untouched, and a column named like a result is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import count_of, words

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
CAPITALS = "A-Z"
DIGITS = "0-9"

SAMPLE_ROWS = 2000


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Bind the text (null: empty) and its words once, as ``__text`` and ``__words``."""
    bound = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    return bound.withColumn("__words", words(F.col("__text")))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside 8-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes.  Only texts with an equal pair of windows
    sort theirs; repeated windows then stand next to each other.
    """
    word = F.transform("__words", lambda w: F.xxhash64(w))
    rows = docs.withColumn("__hash", word)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col("__hash"), i + k) for k in range(WINDOW)])

    starts = F.sequence(F.lit(0), F.size("__hash") - WINDOW)
    rows = rows.withColumn(
        "__windows",
        F.when(F.size("__hash") >= WINDOW, F.transform(starts, window)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs)
    )

    def repeated(x: Column, i: Column) -> Column:
        before = F.get(F.col("__sorted"), i - 1)["h"]
        after = F.get(F.col("__sorted"), i + 1)["h"]
        return before.eqNullSafe(x["h"]) | after.eqNullSafe(x["h"])

    rows = rows.withColumn(
        "__starts", F.sort_array(F.transform(F.filter("__sorted", repeated), lambda x: x["i"]))
    )

    def covered(total: Column, x: Column) -> Column:
        return total + x

    steps = F.transform(
        "__starts",
        lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("__starts"), i + 1) - p, F.lit(WINDOW))
        ).cast("bigint"),
    )
    total = F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), covered), F.lit(0).cast("bigint"))
    return rows.withColumn("n_repeat_words", total).drop(
        "__hash", "__windows", "__sorted", "__starts"
    )


def _lines() -> Column:
    return F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _with(name: str, value: Callable[[], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn(name, value())


def _dup_lines(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__lines", _lines())
    dup = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")
    return rows.withColumn("n_dup_lines", dup).drop("__lines")


#: Each measure and the step that adds it to rows with ``__text`` and ``__words``.
MEASURES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "n_words": _with("n_words", lambda: F.size("__words").cast("bigint")),
    "word_chars": _with("word_chars", lambda: F.length(F.array_join("__words", "")).cast("bigint")),
    "n_symbols": _with("n_symbols", lambda: count_of(F.col("__text"), SYMBOLS)),
    "n_capitals": _with("n_capitals", lambda: count_of(F.col("__text"), CAPITALS)),
    "n_digits": _with("n_digits", lambda: count_of(F.col("__text"), DIGITS)),
    "longest_word": _with("longest_word", lambda: F.array_max(F.transform("__words", F.length)).cast("bigint")),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": with_repeats,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``rejects`` (SQL over the measures in ``needs``) holds."""

    name: str
    rejects: str
    needs: tuple[str, ...]


BASE_RULES = (
    Rule("too_short", "n_words < 20", ("n_words",)),
    Rule("repeats_itself", "100 * n_repeat_words > 30 * n_words", ("n_words", "n_repeat_words")),
)
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words", ("n_words", "n_symbols")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", ("n_words", "word_chars")),
    Rule("capitals", "5 * n_capitals > 2 * word_chars", ("word_chars", "n_capitals")),
    Rule("digits", "2 * n_digits > word_chars", ("word_chars", "n_digits")),
    Rule("endless_word", "longest_word > 1000", ("longest_word",)),
    Rule("repeated_lines", "5 * n_dup_lines > n_words", ("n_words", "n_dup_lines")),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def add_measures(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    for name in dict.fromkeys(names):
        if name not in rows.columns:
            rows = MEASURES[name](rows)
    return rows


def estimate_rules(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS
) -> list[Estimate]:
    """Cost and selectivity of each rule on up to ``sample_rows`` distinct texts, drawn by hash.

    The estimate decides the order of the rules and nothing else.
    """
    hashed = docs.select(text, F.xxhash64(text).alias("__hash"))
    ranks = hashed.select("__hash").distinct().orderBy("__hash").limit(sample_rows)
    last = ranks.agg(F.max("__hash")).first()[0]
    # Texts are fetched for the hashes of the sample only, so no task writes more of them.
    sample = hashed.filter(F.col("__hash") <= F.lit(last)).dropDuplicates(["__hash"]).select(text).cache()
    try:
        rows = sample.count()
        found = []
        for rule in rules:
            measured = add_measures(with_words(sample, text), rule.needs)
            began = time.perf_counter()
            rejected = measured.agg(F.sum(F.expr(rule.rejects).cast("int"))).first()[0]
            found.append(Estimate(rule, time.perf_counter() - began, (rejected or 0) / max(rows, 1)))
    finally:
        sample.unpersist()
    return found


def order_rules(estimates: Sequence[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def cascade(rows: DataFrame, rules: Sequence[Rule], out: str = "rejected_by") -> DataFrame:
    """Name the first rule, in the order given, that rejects a row of ``with_words``.

    Each step measures only the rows that no earlier rule has rejected: the text and the
    words of the others are null from there on.  Measures that are there already are used.
    """
    present = set(rows.columns)
    rows = rows.withColumn(out, F.lit(None).cast("string"))
    for rule in rules:
        missing = [m for m in rule.needs if m not in present]
        if missing:
            open_ = F.col(out).isNull()
            rows = rows.withColumns(
                {"__text": F.when(open_, F.col("__text")), "__words": F.when(open_, F.col("__words"))}
            )
            rows = add_measures(rows, missing)
            present |= set(missing)
        verdict = F.when(F.col(out).isNotNull(), F.col(out)).when(F.expr(rule.rejects), F.lit(rule.name))
        rows = rows.withColumn(out, verdict)
    return rows


def apply_rules(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    base_rules: Sequence[Rule] = BASE_RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add ``kept`` and ``rejected_by``; measures are computed only as far as needed."""
    every = [*base_rules, *rules]
    ordered = order_rules(estimate_rules(docs, text, every, sample_rows))
    rows = cascade(with_words(docs, text), ordered)
    drop = ["__text", "__words", *(m for m in MEASURES if m not in docs.columns)]
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop(*drop)


def report_rules(
    docs: DataFrame,
    text: str = "text",
    measures: Sequence[str] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
    rules: Sequence[Rule] = RULES,
    base_rules: Sequence[Rule] = BASE_RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Add the ``measures`` of every document, ``base_failed``, and the cascade's ``kept``.

    The measures asked for are there for all rows, so the cascade starts from them and
    saves the measures that only its own rules need.
    """
    docs = docs.drop(*[m for m in [*measures, "base_failed", "kept", "rejected_by"] if m in docs.columns])
    rows = add_measures(with_words(docs, text), measures)
    failed = F.expr(" or ".join(f"({r.rejects})" for r in base_rules))
    ordered = order_rules(estimate_rules(docs, text, rules, sample_rows))
    rows = rows.withColumn("base_failed", failed)
    open_ = ~F.col("base_failed")
    rows = rows.withColumns(
        {"__text": F.when(open_, F.col("__text")), "__words": F.when(open_, F.col("__words"))}
    )
    rows = cascade(rows, ordered)
    extra = [m for m in MEASURES if m not in measures and m not in docs.columns]
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return rows.withColumn("kept", kept).drop("__text", "__words", *extra)
