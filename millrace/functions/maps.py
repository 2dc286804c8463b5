"""Map and JSON expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.json_scan import indented


def reverse_lookup(m: Column, value: Column) -> Column:
    """First key, in map order, whose value equals ``value``; null if there is none."""
    return F.get(F.map_keys(F.map_filter(m, lambda _k, v: v == value)), F.lit(0))


def merge_last_wins(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins where both hold a key."""
    kept = F.map_filter(left, lambda k, _v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def sorted_json(json: Column) -> Column:
    """The same document with object keys in order and no spare white space."""
    return F.to_json(F.parse_json(json))


def json_value(json: Column, path: str) -> Column:
    """Text found at a JSON path such as ``$[0].Config.Cmd``."""
    return F.get_json_object(json, path)


def indented_json(json: Column, indent: int = 2, sort_keys: bool = True) -> Column:
    """The same document with a line for each member, of any depth; null stays null, other texts than JSON fail."""

    @F.pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: indented(t, indent, sort_keys), na_action="ignore")

    return write(json)
