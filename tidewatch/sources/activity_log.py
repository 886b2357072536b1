"""The common shape of an activity log.

Every adapter produces one *tagged log*: ``user, date, source, item, bytes_sent,
bytes_received``. ``item`` is the counted column (activity or url), the byte
columns are NULL outside web rows. One tagged log means one scan per file and
one aggregation for all three sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCES

LOG_COLUMNS = ("user", "date", "source", "item", "bytes_sent", "bytes_received")


def tagged_log(logon: DataFrame, http: DataFrame, device: DataFrame) -> DataFrame:
    """Combine three per-source frames into one tagged log."""
    parts = []
    for source, frame in zip(SOURCES, (logon, http, device), strict=True):
        is_web = source == "http"
        number = dict(http.dtypes)
        parts.append(
            frame.select(
                "user",
                "date",
                F.lit(source).alias("source"),
                F.col("url" if is_web else "activity").alias("item"),
                *(
                    F.col(c) if is_web else F.lit(None).cast(number[c]).alias(c)
                    for c in ("bytes_sent", "bytes_received")
                ),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three per-source frames of a tagged log."""
    logon, http, device = (log.where(F.col("source") == s) for s in SOURCES)
    return (
        logon.select("user", "date", F.col("item").alias("activity")),
        http.select("user", "date", F.col("item").alias("url"), "bytes_sent", "bytes_received"),
        device.select("user", "date", F.col("item").alias("activity")),
    )
