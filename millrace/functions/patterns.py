"""Regular-expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.display import ANSI_CODES


def matches_dotall(col: Column, pattern: str) -> Column:
    """Does the pattern occur anywhere, with ``.`` matching line ends too?"""
    return col.rlike("(?s)" + pattern)


def deploy_arg(args: Column, name: str, default: str) -> Column:
    """Value of the first ``--name=value`` in an array of arguments, else ``default``.

    The value is the leading run of word characters; an argument without one is passed over.
    """
    value = r"^--" + name + r"=(\w+)"
    hits = F.filter(args, lambda a: a.rlike(value))
    return F.coalesce(F.regexp_extract(F.get(hits, F.lit(0)), value, 1), F.lit(default))


def strip_ansi(col: Column) -> Column:
    """Remove terminal colour codes."""
    return F.regexp_replace(col, ANSI_CODES, "")
