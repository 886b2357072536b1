"""Activity per user and day from a stream of events, scored with a stored baseline.

Only what a closed window decides runs here. Baselines, thresholds and forests need
the whole history and come from the batch job as stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import risk_level
from ..operators.activity import activity_measures
from ..operators.features import spike_columns
from ..operators.scorers import ZScore
from ..plans.scoring import Thresholds
from ..session import require_utc
from ..sources.events import tag_events
from ..staging import stage_path


def event_stream(
    spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """File-source stream of the event files in a folder, with the batch files' schema.

    ``files_per_batch`` bounds a micro-batch when a long backlog is worked off.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def windowed_activity(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """The five measures per user and window.

    Rows later than ``delay`` are left to the batch job. State is one row per open
    user-window, and partial aggregation runs before the shuffle to the state.
    """
    require_utc(events.sparkSession)
    log = tag_events(events, "raw").where(F.col("user").isNotNull())
    # A watermark needs TIMESTAMP; the wall-clock value is read as UTC and turned back.
    timed = log.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", delay)
    grouped = timed.groupBy(F.window("event_time", window).alias("span"), "user")
    return grouped.agg(*activity_measures(log)).select(
        "user",
        F.col("span.start").cast("timestamp_ntz").alias("date"),
        "logon_count",
        "http_requests",
        "http_bytes_sent",
        "http_bytes_received",
        "device_activity_count",
    )


def scored_activity(activity: DataFrame, baseline: DataFrame, cuts: Thresholds) -> DataFrame:
    """z-score and level of each window against the stored per-user baseline.

    A stream-static left join: a user without a baseline gets score 0.
    """
    spiked = activity.join(baseline, "user", "left").withColumns(spike_columns())
    scored = ZScore().fit(spiked).transform(spiked).withColumnRenamed("raw_score", "risk_score")
    level = risk_level(F.col("risk_score"), cuts.medium, cuts.high)
    return scored.withColumn("risk_level", level).drop(*(c for c in baseline.columns if c != "user"))


def open_windows(closed: DataFrame, events: DataFrame, window: str = "1 day") -> DataFrame:
    """The windows of the batch table ``events`` behind the last of ``closed``.

    The watermark has not closed these yet. Closed and open together are the batch answer, but
    for rows that came too late for their window. The end of the last closed window goes to the scan
    as a literal, so only row groups behind it are read.
    """
    last = closed.agg(F.max("date")).first()[0]
    if last is None:
        return windowed_activity(events, window)
    start = F.lit(last).cast("timestamp_ntz")
    behind = events.where(F.col("ts") >= start + F.expr(f"INTERVAL {window}"))
    return windowed_activity(behind, window).where(F.col("date") > start)


def drain(stream: DataFrame, name: str = "stream", path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table and open it.

    Append mode with a checkpoint: a later run with the same ``path`` and ``checkpoint`` goes on
    with new files and repeats nothing. Without them the table is a new one in the shared folder.
    """
    spark = stream.sparkSession
    path = path or stage_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
