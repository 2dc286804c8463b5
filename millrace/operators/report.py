"""Report output: numbers and rows as padded text, and the four listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.display import justify, wrap
from millrace.functions.strings import header_style
from millrace.operators.aggregates import column_widths
from millrace.operators.joins import snapshots_with_base, stacks_with_snapshot_time

BLANK_CELL = " "


def format_numbers(
    df: DataFrame,
    int_format: Mapping[str, str] | None = None,
    float_format: Mapping[str, str] | None = None,
) -> DataFrame:
    """Whole numbers as ``%<fmt>d``, fractions as ``%<fmt>f``; other columns become text."""
    ints, floats = int_format or {}, float_format or {}
    for name, fmt in ints.items():
        if fmt and not fmt.isdigit():
            raise ValueError(f"invalid integer format {fmt!r} for {name}")
    for name, fmt in floats.items():
        whole, dot, digits = fmt.partition(".")
        if fmt and not (dot and all(b == "" or b.isdigit() for b in (whole, digits))):
            raise ValueError(f"invalid float format {fmt!r} for {name}")

    def cell(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType) and field.name in ints:
            text = F.format_string(f"%{ints[field.name]}d", col)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)) and field.name in floats:
            fmt = floats[field.name]
            text = F.format_string(f"%{fmt}{'0' if fmt.endswith('.') else ''}f", col)
        else:
            return F.coalesce(col.cast("string"), F.lit("None")).alias(field.name)
        return F.when(col.isNull(), "None").otherwise(text).alias(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def format_report_columns(
    df: DataFrame,
    align: Mapping[str, str] | None = None,
    valign: Mapping[str, str] | None = None,
    min_width: Mapping[str, int] | None = None,
    max_width: Mapping[str, int] | None = None,
    widths: DataFrame | None = None,
    line: str = "line",
) -> DataFrame:
    """Every cell padded to the width of its column, one output row per display line.

    Cells with line ends, or wider than a capped column, take several lines; shorter
    neighbours are filled with blank lines below (``t``), around (``m``) or above (``b``).
    ``align`` is ``l``, ``c`` (default) or ``r`` per column.
    """
    align, valign = align or {}, valign or {}
    text = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in df.columns]
    )
    capped = max_width or {}
    may_wrap = set(df.columns) if widths is not None else set(capped)
    sizes = widths if widths is not None else column_widths(text, min_width, capped)
    wide = sizes.select(F.struct(*df.columns).alias("w")).scalar()

    def lines_of(name: str) -> Column:
        parts = F.split(F.col(name), "\n")
        if name not in may_wrap:
            return parts
        return F.flatten(F.transform(parts, lambda p: wrap(p, F.col("__w")[name])))

    rows = text.withColumn("__w", wide)
    rows = rows.select(*[lines_of(c).alias(c) for c in df.columns])
    heights = [F.size(c) for c in df.columns]
    rows = rows.withColumn("__h", F.greatest(*heights) if len(heights) > 1 else heights[0])

    def cell(name: str, at: Column) -> Column:
        spare = F.col("__h") - F.size(name)
        above = {"t": F.lit(0), "m": F.floor(spare / 2).cast("int"), "b": spare}[
            valign.get(name, "t")
        ]
        found = F.when(at >= above, F.get(F.col(name), at - above))
        return F.coalesce(found, F.lit("")).alias(name)

    # Lines leave the row one by one, so that no output line drags the whole cells along.
    lines = F.transform(
        F.sequence(F.lit(0), F.col("__h") - 1),
        lambda at: F.struct(at.alias(line), *[cell(c, at) for c in df.columns]),
    )
    single = rows.select(F.inline(lines)).withColumn("__w", wide)
    return single.select(
        line,
        *[justify(F.col(c), F.col("__w")[c], align.get(c, "c")).alias(c) for c in df.columns],
    )


def report_header(
    df: DataFrame, widths: DataFrame, align: Mapping[str, str] | None = None, style: str | None = None
) -> DataFrame:
    """Two rows: the styled column names and dashes below them, padded like the cells."""
    align = align or {}

    def cell(name: str, dashes: bool) -> Column:
        head = header_style(F.lit(name), style)
        shown = F.repeat(F.lit("-"), F.char_length(head)) if dashes else head
        return justify(shown, F.col(name), align.get(name, "c")).alias(name)

    return widths.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("line"), *[cell(c, False) for c in df.columns]),
                F.struct(F.lit(1).alias("line"), *[cell(c, True) for c in df.columns]),
            )
        )
    )


def stack_listing(stacks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stacks with storage, compute and connector ids as text, status, base and time."""
    timed = stacks_with_snapshot_time(stacks, snapshots)
    uuids = F.col("backends.uuids")

    def blank(col: Column) -> Column:
        return F.coalesce(col, F.lit(BLANK_CELL))

    storage = F.transform(uuids, lambda b: blank(F.nullif(b["storage"], F.lit(""))))
    compute = F.transform(
        uuids,
        lambda b: F.when(
            F.coalesce(F.size(b["compute"]), F.lit(0)) > 0,
            F.concat(F.lit("["), F.array_join(b["compute"], ", "), F.lit("]")),
        ).otherwise(BLANK_CELL),
    )
    return timed.select(
        F.col("uuid").alias("UUID"),
        F.array_join(storage, ", ").alias("Storage"),
        F.array_join(compute, ", ").alias("Compute"),
        F.array_join("connectors", ", ").alias("Connectors"),
        F.col("status").alias("Status"),
        F.col("base").alias("Base"),
        F.col("ts").alias("Time"),
    )


def snapshot_listing(snapshots: DataFrame, clusters: DataFrame) -> DataFrame:
    """Snapshots with base and date; a missing date shows as a blank."""
    rows = snapshots_with_base(snapshots, clusters)
    return rows.select(
        F.col("uuid").alias("UUID"),
        F.col("base").alias("Base"),
        F.coalesce("snapshot_ts", F.lit(BLANK_CELL)).alias("Date"),
    )


def app_listing(apps: DataFrame) -> DataFrame:
    """Applications with author, version and the shortened description."""
    return apps.select(
        F.col("name").alias("App"),
        F.col("author").alias("Author"),
        F.col("version").alias("Version"),
        F.col("short").alias("Description"),
    )


def image_listing(images: DataFrame, col: str) -> DataFrame:
    """Distinct images."""
    return images.select(F.col(col).alias("Image")).distinct()
