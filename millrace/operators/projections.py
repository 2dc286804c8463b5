"""Column selection, computed columns, defaults, templates and row expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.strings import ID_PREFIXES, short_id
from millrace.operators.numbering import as_columns, explode_range, number_rows

# Memory floors in MB, the share of memory given to the heap, preview length.
MIN_MEMORY = 1024
MIN_TASK_MEMORY = 512
HEAP_SHARE = 0.8
PREVIEW_CHARS = 21
PREVIEW_TAIL = "..."
MASTERS_PER_CLUSTER = 2


def select_fields(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """Keep a subset of the columns in table order; an unknown name is an error."""
    if not fields:
        return df
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    return df.select(*[c for c in df.columns if c in fields])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every column but ``cols``."""
    return df.drop(*cols)


def derive_sizing(df: DataFrame, memory: str, cores: str, nodes: str) -> DataFrame:
    """Container sizing per row from whole-number memory (MB), cores and node count."""
    mem = F.greatest(F.col(memory).cast("bigint"), F.lit(MIN_MEMORY).cast("bigint"))
    rows = df.withColumn("total_mb", mem).withColumn(
        "task_mb", F.greatest(F.expr("total_mb div 8"), F.lit(MIN_TASK_MEMORY).cast("bigint"))
    )
    workers = F.col(nodes).cast("bigint") - MASTERS_PER_CLUSTER
    slots = F.greatest(F.col(cores).cast("bigint"), F.lit(1).cast("bigint"))
    return (
        rows.withColumn("reduce_mb", F.col("task_mb") * 2)
        .withColumn("task_heap", _heap(F.col("task_mb")))
        .withColumn("reduce_heap", _heap(F.col("reduce_mb")))
        .withColumn("node_cores", F.greatest(F.expr(f"`{cores}` div 2"), F.lit(1).cast("bigint")))
        .withColumn("node_maps", slots * 4)
        .withColumn("job_maps", slots * 4 * workers)
        .withColumn("job_reduces", slots * workers)
    )


def _heap(mb: Column) -> Column:
    return F.concat(F.lit("-Xmx"), F.floor(mb * HEAP_SHARE).cast("string"), F.lit("m"))


def fill_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Replace nulls by a default; a list default is an array literal, a Column is used as is."""

    def literal(value: Any, type_name: str) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast(type_name)
        return F.lit(value).cast(type_name)

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.withColumns(
        {c: F.coalesce(F.col(c), literal(v, types[c])) for c, v in defaults.items()}
    )


def truncate_description(
    df: DataFrame, col: str, n: int = PREVIEW_CHARS, out: str = "short"
) -> DataFrame:
    """The first ``n`` characters, always followed by the ellipsis."""
    return df.withColumn(out, F.concat(F.substring(F.col(col), 1, n), F.lit(PREVIEW_TAIL)))


def zip_columns(
    df: DataFrame,
    other: DataFrame,
    df_order: Sequence[Column | str],
    other_order: Sequence[Column | str],
    unique: bool = False,
) -> DataFrame:
    """Attach the columns of ``other`` by row position; both sides must be equally long."""
    left = number_rows(df, df_order, "__rn", unique)
    right = number_rows(other, other_order, "__rn", unique)
    sizes = left.count(), right.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"{sizes[1]} values for a table of {sizes[0]} rows")
    return left.join(right, "__rn").drop("__rn")


def substitute_template(
    df: DataFrame, col: str, params: Mapping[str, str] | Column, out: str
) -> DataFrame:
    """Replace ``$name`` / ``${name}`` and ``{name}`` in one pass over the text.

    ``params`` is a small mapping or a map column.  An unknown ``$name`` fails the job, an
    unknown ``{name}`` stays as it is, ``$$`` stands for one dollar sign.  Values are not
    scanned again, so a value may itself contain a placeholder.
    """
    if isinstance(params, Column):
        lookup = params
    else:
        entries = [F.lit(x) for pair in params.items() for x in pair]
        lookup = F.create_map(*entries) if entries else F.lit(None).cast("map<string,string>")
    piece = (
        r"\$\$|\$[A-Za-z_][A-Za-z0-9_]*|\$\{[A-Za-z_][A-Za-z0-9_]*\}|\{[^{}$]*\}|[^${]+|\$|\{"
    )
    rows = df.withColumn("__params", lookup)

    def render(token: Column) -> Column:
        braced = F.try_element_at(
            F.col("__params"), F.regexp_replace(token, r"^\{(.*)\}$", "$1")
        )
        named = F.try_element_at(
            F.col("__params"), F.regexp_replace(token, r"^\$\{?([A-Za-z0-9_]*)\}?$", "$1")
        )
        unknown = F.raise_error(F.concat(F.lit("unknown placeholder "), token)).cast("string")
        return (
            F.when(token == "$$", F.lit("$"))
            .when(F.startswith(token, F.lit("$")), F.coalesce(named, unknown))
            .when(F.startswith(token, F.lit("{")), F.coalesce(braced, token))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(F.col(col), F.lit(piece), F.lit(0))
    return rows.withColumn(out, F.array_join(F.transform(tokens, render), "")).drop("__params")


def assign_short_ids(df: DataFrame, key: str, kind: str, out: str = "short_id") -> DataFrame:
    """A short id per row from its unique ``key``; where ids collide all but one get a number.

    Ids are spread evenly, so the rows that share one are few.
    """
    rows = df.withColumn(out, short_id(ID_PREFIXES[kind], F.col(key)))
    place = F.row_number().over(Window.partitionBy(out).orderBy(key))
    numbered = F.concat(F.col(out), F.lit("-"), F.col("__n").cast("string"))
    return (
        rows.withColumn("__n", place)
        .withColumn(out, F.when(F.col("__n") > 1, numbered).otherwise(F.col(out)))
        .drop("__n")
    )


def expand_instances(
    df: DataFrame, n_col: str, name_col: str, index: str = "instance"
) -> DataFrame:
    """One row per instance (a missing count means one); names get ``-i`` when there are several."""
    count = F.coalesce(F.col(n_col), F.lit(1))
    rows = explode_range(df.withColumn(n_col, count), F.col(n_col), index)
    suffixed = F.concat(F.col(name_col), F.lit("-"), F.col(index).cast("string"))
    return rows.withColumn(name_col, F.when(F.col(n_col) > 1, suffixed).otherwise(F.col(name_col)))


def cluster_instances(n: Column, layers: Column) -> Column:
    """Containers of a cluster: the workers, two masters, and one more if a layer is set."""
    layered = F.when(F.coalesce(F.size(layers), F.lit(0)) > 0, 1).otherwise(0)
    return n + MASTERS_PER_CLUSTER + layered


def assign_roles(
    df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "role"
) -> DataFrame:
    """First row of a group is the compute master, the second the storage master, the rest workers.

    ``group`` and ``order`` together identify a row.  Each task passes on at most two rows
    per group, so a group that holds a large share of the table stays spread out.
    """
    first = Window.partitionBy(*group).orderBy(*as_columns(order))
    masters = (
        df.select(*group, *order)
        .withColumn("__pos", F.row_number().over(first))
        .filter(F.col("__pos") <= MASTERS_PER_CLUSTER)
    )
    role = (
        F.when(F.col("__pos") == 1, "compute_master")
        .when(F.col("__pos") == 2, "storage_master")
        .otherwise("worker")
    )
    return df.join(masters, [*group, *order], "left").withColumn(out, role).drop("__pos")


def require_all_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the key columns of a row only if all of them are present, else null them all."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.withColumns({k: F.when(complete, F.col(k)) for k in keys})
