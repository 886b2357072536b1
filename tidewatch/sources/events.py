"""Adapter for a single event table that stands in for the three logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import truncate

# Which event types play which log.
LOGON_TYPES = ("signup", "error")
HTTP_TYPES = ("view", "click")
DEVICE_TYPES = ("purchase",)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def tag_events(events: DataFrame, grain: str = "hour") -> DataFrame:
    """One pass over the event table; columns a query does not use are never read."""
    kind = F.col("event_type")
    is_web = kind.isin(*HTTP_TYPES)
    return events.where(kind.isin(*LOGON_TYPES, *HTTP_TYPES, *DEVICE_TYPES)).select(
        F.col("user_id").alias("user"),
        truncate(F.col("ts"), grain).alias("date"),
        F.when(kind.isin(*LOGON_TYPES), "logon").when(is_web, "http").otherwise("device").alias("source"),
        kind.alias("item"),
        F.when(is_web, F.col("value")).alias("bytes_sent"),
        F.when(is_web, F.get_json_object("props", "$.k").cast("bigint")).alias("bytes_received"),
    )
