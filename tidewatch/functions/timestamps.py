"""Wall-clock timestamps: parsing and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("raw", "minute", "hour", "day")


def truncate(ts: Column, grain: str) -> Column:
    """Truncate a TIMESTAMP_NTZ without passing through the session time zone."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    if grain == "raw":
        return ts
    midnight = F.to_date(ts).cast("timestamp_ntz")
    if grain == "day":
        return midnight
    minutes = F.minute(ts) if grain == "minute" else F.lit(0)
    return midnight + F.make_dt_interval(F.lit(0), F.hour(ts), minutes)


def parse(text: Column, fmt: str) -> Column:
    """Parse text to TIMESTAMP_NTZ; text that does not fit becomes NULL (UTC sessions)."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
