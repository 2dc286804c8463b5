"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.maths import whole_number


def listing_time(ts: Column) -> Column:
    """``MM/weekday/yyyy (hh:mm AM)``: the middle field is the weekday, Sunday being 0."""
    weekday = (F.dayofweek(ts) - 1).cast("string")
    return F.concat(
        F.date_format(ts, "MM/"), weekday, F.date_format(ts, "/yyyy (hh:mm a)")
    )


def epoch_timestamp(seconds: Column) -> Column:
    """Timestamp of whole epoch seconds kept as text or number; bad text gives null."""
    return F.timestamp_seconds(whole_number(seconds))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock time, whatever the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400
    return day + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
