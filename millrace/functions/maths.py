"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(col: Column, default: int = 0) -> Column:
    """Whole number from text, ``default`` where the text is not one or does not fit."""
    number = whole_number(col)
    fits = number.between(-(2**31), 2**31 - 1)
    return F.when(fits, number.cast("int")).otherwise(F.lit(default))


def whole_number(col: Column) -> Column:
    """``bigint`` from text, null for anything else.

    The pattern is much cheaper than a failed ``try_cast``, which costs an exception per row.
    """
    text = col.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?[0-9]{1,18}\s*\z"), F.trim(text).cast("bigint"))


def block_size(prefix: Column) -> Column:
    """Addresses in an IPv4 block of the given prefix length."""
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.lit(32) - prefix).cast("int")
    )


def squared(col: Column) -> Column:
    return col * col
