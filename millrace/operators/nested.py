"""Nested documents: children of a document, leaves, deep merge, key/value pairs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.json_scan import leaves
from millrace.functions.maps import reverse_lookup
from millrace.operators.keys import deal_rows, salted_join

# Fixed value: what a nested object adds to the prefix of its keys.
LAYER_TAG = "LAYER"


def backend_uuids(df: DataFrame, backends: str = "backends") -> DataFrame:
    """Storage and compute ids of ``backends.uuids[]`` as two flat arrays, nulls left out."""
    uuids = F.col(f"{backends}.uuids")
    storage = F.filter(F.transform(uuids, lambda b: b["storage"]), lambda s: s.isNotNull())
    compute = F.flatten(
        F.transform(uuids, lambda b: F.coalesce(b["compute"], F.array().cast("array<string>")))
    )
    return df.withColumn("storage", storage).withColumn("compute", compute)


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    key: str,
    classes: Mapping[str, str],
    child_key: str,
    salt: int = 1,
) -> DataFrame:
    """Replace arrays of child ids by arrays of child records, in order.

    ``classes`` maps each output column to the id array it is built from.  A child that
    is not found stays as a record with only its id.  All arrays are resolved in one join,
    and a parent's records come back together only as far as its own arrays reach.
    ``salt`` spreads the references to one child over that many tasks.
    """
    fields = [c for c in children.columns if c != child_key]

    def references(out: str, ids: str) -> Column:
        return F.transform(
            F.coalesce(F.col(ids), F.array().cast("array<string>")),
            lambda child, i: F.struct(
                F.lit(out).alias("cls"), i.alias("pos"), child.alias(child_key)
            ),
        )

    refs = parents.select(
        key, F.inline(F.concat(*[references(o, ids) for o, ids in classes.items()]))
    )
    found = salted_join(refs, children, [child_key], "left", [key], salt)
    record = F.struct("pos", child_key, *fields)
    nested = found.groupBy(key).agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("cls") == out, record))).alias(f"__{out}")
            for out in classes
        ]
    )
    whole = parents.join(nested, key, "left")
    record_type = T.ArrayType(children.select(child_key, *fields).schema)

    def tidy(out: str) -> Column:
        # A parent without any child has no row in ``nested``.
        rows = F.transform(
            F.col(f"__{out}"), lambda r: F.struct(*[r[c].alias(c) for c in [child_key, *fields]])
        )
        empty = F.from_json(F.lit("[]"), record_type)
        return F.coalesce(rows, empty)

    kept = [c for c in parents.columns if c not in classes.values()]
    return whole.select(*kept, *[tidy(out).alias(out) for out in classes])


def find_mount(df: DataFrame, volumes: str, target: str, out: str = "source") -> DataFrame:
    """Reverse lookup in a map column: the first key that is mounted at ``target``."""
    return df.withColumn(out, reverse_lookup(F.col(volumes), F.col(target)))


def json_leaves(
    df: DataFrame, key: str, json: str, into_lists: bool = False, keep_empty: bool = False
) -> DataFrame:
    """``key, path, value`` per leaf of a JSON object column; ``path`` is an array of names.

    ``value`` is a variant, so strings and numbers can be told apart.  Lists are leaves
    unless ``into_lists``; an empty object is a leaf only with ``keep_empty``; null has no leaves.
    Documents may nest to any depth: each is read in one pass over its tokens, in its own task.
    """
    found = _scan(df, key, json, into_lists, False)
    if not keep_empty:
        found = found.filter(~F.col("value").rlike(r"^\{\s*\}$"))
    return found.select(key, "path", F.parse_json("value").alias("value"))


LEAVES_AT_A_TIME = 10_000
DOCUMENTS_A_TASK = 20_000  # whose pairs one task reads and sorts


def _scan(df: DataFrame, key: str, json: str, into_lists: bool, top_lists: bool) -> DataFrame:
    """``key, item, path, value`` per leaf; ``value`` is its JSON text.  Rows stay in their tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []

            def rows() -> pa.RecordBatch:
                columns = zip(*found, strict=True) if found else ((), (), ())
                kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                own = batch.column(0).take(pa.array(keys, pa.int64()))
                return pa.RecordBatch.from_arrays([own, *arrays], names=[key, "item", "path", "value"])

            for i, text in enumerate(batch.column(1).to_pylist()):
                for leaf in leaves(text, into_lists, top_lists) if text is not None else ():
                    keys.append(i)
                    found.append(leaf)
                    if len(keys) >= LEAVES_AT_A_TIME:
                        yield rows()
                        keys.clear()
                        found.clear()
            yield rows()

    fields = [df.schema[key], *T._parse_datatype_string("item array<int>, path array<string>, value string").fields]
    return df.select(key, F.col(json).alias("__json")).mapInArrow(read, T.StructType(fields))


def flatten_to_pairs(df: DataFrame, key: str, json: str, prefix: str) -> DataFrame:
    """``PREFIX_KEY`` pairs of the text values of a document.

    Names are upper-cased; a nested object adds a fixed tag to the prefix instead of its
    own name; numbers, booleans and lists inside objects are left out.  A document that is
    a list, also of lists, contributes the pairs of all its objects.  Where two values meet
    under one name the later one wins (list position, then path).
    """
    found = _scan(deal_rows(df.select(key, json), DOCUMENTS_A_TASK), key, json, False, True)
    text = found.filter(F.col("value").startswith('"') & (F.size("path") > 0))
    layers = F.repeat(F.lit(f"_{LAYER_TAG}"), F.size("path") - 1)
    name = F.concat(F.lit(prefix), layers, F.lit("_"), F.upper(F.element_at("path", -1)))
    pairs = text.select(
        key,
        name.alias("name"),
        F.parse_json("value").cast("string").alias("value"),
        F.struct("item", "path").alias("__at"),
    )
    return pairs.groupBy(key, "name").agg(F.max_by("value", "__at").alias("value"))


def merge_config(left: DataFrame, right: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Deep merge of two leaf tables (``key, path, value``): the right one wins.

    A right leaf replaces the left leaf at its path and the whole left subtree below it.
    A left leaf where the right side has a subtree fails the job if ``strict``, else it goes.
    On each side no path may lead on from another, which holds for the leaves of a document.

    The leaves of a document meet in one shuffle and are sorted by path.  Whatever stands between a
    path and one that leads on from it leads on from it too, so a left leaf need only look
    at the right leaf before it and the one after it.
    """
    sides = left.select(key, "path", "value", F.lit(1).alias("__side")).unionByName(
        right.select(key, "path", "value", F.lit(0).alias("__side"))
    )
    other = F.when(F.col("__side") == 0, F.col("path"))
    until_here = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(key).orderBy("path", "__side").rowsBetween(*until_here)
    down = Window.partitionBy(key).orderBy(F.desc("path"), F.desc("__side")).rowsBetween(*until_here)
    rows = sides.withColumns(
        {"__before": F.last(other, ignorenulls=True).over(up), "__after": F.last(other, ignorenulls=True).over(down)}
    )
    own = F.col("__side") == 1
    replaced = own & F.coalesce(_leads_to(F.col("__before"), F.col("path")), F.lit(False))
    clash = own & ~replaced & F.coalesce(_leads_to(F.col("path"), F.col("__after")), F.lit(False))
    if strict:
        text = F.concat(F.lit("a plain value meets a subtree at "), F.array_join("path", "."))
        stays = F.when(clash, F.raise_error(text).cast("boolean")).otherwise(~replaced)
    else:
        stays = ~replaced & ~clash
    return rows.filter(stays).select(key, "path", "value")


def _leads_to(path: Column, other: Column) -> Column:
    """Is ``other`` the path itself, or does it lead on from it?"""
    return F.slice(other, F.lit(1), F.size(path)) == path
