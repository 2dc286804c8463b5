"""Words and other text measures as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space between words (space and the controls TAB to CR).
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of characters between white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the pattern class ``characters``."""
    return (F.size(F.split(text, f"[{characters}]")) - 1).cast("bigint")
