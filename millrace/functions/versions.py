"""Dotted version numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.maths import safe_int

VERSION_PARTS = 3


def parse_version(col: Column) -> Column:
    """The first three parts as integers: leading digits count, anything else is zero."""
    parts = F.slice(F.split(col, r"\."), 1, VERSION_PARTS)
    digits = F.transform(
        parts,
        lambda p: safe_int(F.regexp_extract(p, r"^(\d+)", 1)),
    )
    padding = F.array_repeat(F.lit(0), VERSION_PARTS)
    return F.slice(F.concat(digits, padding), 1, VERSION_PARTS)


def version_at_least(col: Column, minimum: Sequence[int]) -> Column:
    """Part-by-part comparison with a minimum of three parts."""
    return parse_version(col) >= F.array(*[F.lit(int(m)) for m in minimum])
