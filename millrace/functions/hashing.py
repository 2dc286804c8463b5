"""Hash values that depend on their input only, not on partitioning or cluster size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def stable_hash(seed: int | str, *cols: Column) -> Column:
    """A non-negative 60-bit integer from ``seed`` and the text of ``cols``."""
    text = F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def unit_interval(seed: int | str, *cols: Column) -> Column:
    """A double in ``[0, 1)`` from the same hash."""
    return stable_hash(seed, *cols).cast("double") / F.lit(float(2**HASH_BITS))
