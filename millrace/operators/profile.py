"""Column statistics and heavy hitters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import epoch_seconds
from millrace.operators.keys import deal_rows
from millrace.operators.numbering import number_rows
from millrace.scratch import persist_table

_STATS = (
    ("long_low", "bigint"),
    ("long_high", "bigint"),
    ("double_low", "double"),
    ("double_high", "double"),
    ("decimal_low", "string"),
    ("decimal_high", "string"),
    ("num_nulls", "bigint"),
    ("num_distincts", "bigint"),
    ("avg_length", "double"),
    ("max_length", "bigint"),
    ("num_trues", "bigint"),
    ("num_falses", "bigint"),
)


def _column_stats(field: T.StructField, exact: bool) -> Column:
    """Aggregates of one column as a struct; statistics that do not fit its type are null."""
    col, kind = F.col(field.name), field.dataType
    distinct = F.count_distinct(col) if exact else F.approx_count_distinct(col)
    stats: dict[str, Column] = {
        "num_nulls": F.count_if(col.isNull()),
        "num_distincts": distinct,
    }
    if isinstance(kind, T.BooleanType):
        stats |= {"num_trues": F.count_if(col), "num_falses": F.count_if(~col)}
    elif isinstance(kind, T.IntegralType):
        stats |= {"long_low": F.min(col), "long_high": F.max(col)}
    elif isinstance(kind, T.DecimalType):
        stats |= {"decimal_low": F.min(col), "decimal_high": F.max(col)}
    elif isinstance(kind, T.NumericType):
        stats |= {"double_low": F.min(col), "double_high": F.max(col)}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        seconds = epoch_seconds(col)
        stats |= {"long_low": F.min(seconds), "long_high": F.max(seconds)}
    elif isinstance(kind, T.StringType):
        size = F.char_length(col)
        stats |= {"avg_length": F.avg(size), "max_length": F.max(size)}
    values = [stats.get(name, F.lit(None)).cast(t).alias(name) for name, t in _STATS]
    head = [F.lit(field.name).alias("column_name"), F.lit(kind.simpleString()).alias("column_type")]
    return F.struct(*head, *values)


DISTINCT_ROWS = 250_000  # whose values one task groups by itself, before they are shuffled


def profile_columns(df: DataFrame, by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """One row per column (and per value of ``by``) with its statistics, from one pass.

    Distinct counts are HyperLogLog estimates unless ``exact``; exact ones add a shuffle
    of the distinct (column, value) pairs, which tasks of bounded size group first.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    if exact:
        df = deal_rows(df, DISTINCT_ROWS)
    row = df.groupBy(*by).agg(F.array(*[_column_stats(f, exact) for f in fields]).alias("__stats"))
    return row.select(*by, F.inline("__stats"))


# Statistics that can be added up: of a column, in a partition or in many.
_PARTS = (
    ("rows", "bigint"),
    ("nulls", "bigint"),
    ("trues", "bigint"),
    ("falses", "bigint"),
    ("chars", "bigint"),
    ("max_length", "bigint"),
    ("long_low", "bigint"),
    ("long_high", "bigint"),
    ("double_low", "double"),
    ("double_high", "double"),
    ("decimal_low", "decimal(38,10)"),
    ("decimal_high", "decimal(38,10)"),
    ("distincts", "binary"),
    ("quantiles", "binary"),
)
_SUMS = ("rows", "nulls", "trues", "falses", "chars")
DISTINCT_BITS = 14  # of the sketches of distinct values: 2^14 registers of 4 bits, about 1 % of error


def _parts(field: T.StructField) -> Column:
    col, kind = F.col(field.name), field.dataType
    known = F.when(col.isNotNull(), F.to_json(F.struct(col)))
    parts: dict[str, Column] = {
        "rows": F.count(F.lit(1)),
        "nulls": F.count_if(col.isNull()),
        "distincts": F.hll_sketch_agg(known, F.lit(DISTINCT_BITS)),
    }
    if isinstance(kind, T.BooleanType):
        parts |= {"trues": F.count_if(col), "falses": F.count_if(~col)}
    elif isinstance(kind, T.StringType):
        size = F.char_length(col)
        parts |= {"chars": F.sum(size), "max_length": F.max(size)}
    elif isinstance(kind, T.DecimalType):
        parts |= {"decimal_low": F.min(col), "decimal_high": F.max(col)}
        parts["quantiles"] = F.kll_sketch_agg_double(col.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)):
        number = col if isinstance(kind, T.IntegralType) else epoch_seconds(col)
        parts |= {"long_low": F.min(number), "long_high": F.max(number)}
        parts["quantiles"] = F.kll_sketch_agg_double(number.cast("double"))
    elif isinstance(kind, T.NumericType):
        parts |= {"double_low": F.min(col), "double_high": F.max(col)}
        parts["quantiles"] = F.kll_sketch_agg_double(col.cast("double"))
    values = [parts.get(name, F.lit(None)).cast(t).alias(name) for name, t in _PARTS]
    head = [F.lit(field.name).alias("column_name"), F.lit(kind.simpleString()).alias("column_type")]
    return F.struct(*head, *values)


def partition_statistics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each value of ``by`` and each other column: exact counts and bounds, sketches of the rest.

    Such rows are small and can be stored; ``merge_statistics`` adds them up without the data.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    row = df.groupBy(*by).agg(F.array(*[_parts(f) for f in fields]).alias("__stats"))
    return row.select(*by, F.inline("__stats"))


def merge_statistics(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add up stored statistics, over all that ``by`` does not tell apart; the result can be merged again.

    A new partition is ``merge_statistics(stored.unionByName(partition_statistics(new, ...)), by)``; one that
    replaces an old partition takes the place of its rows.  Old data is never read again.
    """
    merged = []
    for name, kind in _PARTS:
        if name in _SUMS:
            out = F.sum(name)
        elif name == "distincts":
            out = F.hll_union_agg(name)
        elif name == "quantiles":
            out = F.kll_merge_agg_double(name)
        else:
            out = F.min(name) if name.endswith("low") else F.max(name)
        merged.append(out.cast(kind).alias(name))
    return stored.groupBy(*by, "column_name", "column_type").agg(*merged)


def read_statistics(stored: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """What ``profile_columns`` gives, from stored statistics, and ``quantiles`` (estimates, null if not a number)."""
    keep = [c for c in stored.columns if c not in dict(_PARTS)]
    known = F.col("rows") - F.col("nulls")
    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    return stored.select(
        *keep,
        "long_low", "long_high", "double_low", "double_high",
        F.col("decimal_low").cast("string").alias("decimal_low"),
        F.col("decimal_high").cast("string").alias("decimal_high"),
        F.col("nulls").alias("num_nulls"),
        F.when(known > 0, F.hll_sketch_estimate("distincts")).otherwise(0).alias("num_distincts"),
        (F.col("chars") / F.when(known > 0, known)).alias("avg_length"),
        "max_length",
        F.col("trues").alias("num_trues"),
        F.col("falses").alias("num_falses"),
        F.when(F.coalesce("long_low", "double_low", F.col("decimal_low").cast("double")).isNotNull(),
               F.kll_sketch_get_quantile_double("quantiles", wanted)).alias("quantiles"),
    )


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """What ``percentile`` gives for a column of numbers, from a distributed sort; null if no value is known.

    Only the rows at the wanted places, at most two for each share, reach the driver.
    """
    known = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    tied = known.withColumn("__tie", F.monotonically_increasing_id())  # a value that fills the table is cut too
    sorted_rows = number_rows(tied, ["v", "__tie"], "rn", unique=True)
    last = sorted_rows.count() - 1
    if last < 0:
        return None
    places = [last * share for share in shares]
    wanted = {int(at) + 1 for p in places for at in (np.floor(p), np.ceil(p))}
    values = {r.rn: r.v for r in sorted_rows.filter(F.col("rn").isin(sorted(wanted))).collect()}

    def between(p: float) -> float:
        low, high = int(np.floor(p)), int(np.ceil(p))
        if low == high or values[low + 1] == values[high + 1]:
            return values[low + 1]
        return (high - p) * values[low + 1] + (p - low) * values[high + 1]

    return [between(p) for p in places]


def heavy_candidates(df: DataFrame, cols: Sequence[str], share: float) -> tuple[DataFrame, int]:
    """Hashes of all tuples that may hold more than ``share`` of the rows, at most ``2 / share``; and the row count.

    Each task keeps ``2 / share`` counters (Misra and Gries): when there are more, all
    lose what the first one too many has.  So a counter misses at most a share of ``share / 2`` of the rows
    its task read, and the sums of the tasks' counters at most that of all rows.
    """
    counters = int(2 / share) + 1

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            rows += len(batch)
            new, times = np.unique(batch["h"].to_numpy(), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            if len(keys) > counters:
                cut = np.partition(counts, -counters - 1)[-counters - 1]
                keys, counts = keys[counts > cut], counts[counts > cut] - cut
        yield pd.DataFrame({"h": np.append(keys, 0), "n": np.append(counts, rows), "total": np.arange(len(keys) + 1) == len(keys)})

    hashed = df.select(F.xxhash64(*cols).alias("h"))
    found = persist_table(hashed.mapInPandas(summarise, "h bigint, n bigint, total boolean"), "heavy")
    total = found.filter("total").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = share * total - total / (counters + 1)
    return found.filter("NOT total").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), total


def skewed_values(df: DataFrame, cols: Sequence[str], share: float) -> DataFrame:
    """Value tuples that hold more than ``share`` of all rows, with their exact counts.

    The tuples that may are found in a first pass that shuffles a bounded number of counters; a second one
    counts these, so the distinct tuples of the table are never gathered.
    """
    if not 0 < share <= 1:
        raise ValueError(f"{share} is no share of the rows")
    candidates, total = heavy_candidates(df, cols, share)
    # At most 2 / share rows, whatever the table holds.
    rows = df.withColumn("__h", F.xxhash64(*cols)).join(
        F.broadcast(candidates.withColumnRenamed("h", "__h")), "__h", "left_semi"
    )
    counts = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.filter(F.col("cnt") > share * total)
