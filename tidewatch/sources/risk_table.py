"""The scored table: written by the scoring job, opened by the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXPORT, MEASURES

# Counts are read as DOUBLE and cast: data-frame libraries write "3.0" once a join
# left gaps. Byte sums stay DOUBLE, as a source may hold fractions.
CALENDAR = ("hour", "weekday", "is_working_day", "is_off_hours")
TEXT_TYPES = {"user": "STRING", "date": "TIMESTAMP_NTZ", "risk_level": "STRING", **dict.fromkeys(CALENDAR, "INT")}


def as_report_table(risk: DataFrame) -> DataFrame:
    """``date`` as DATE for the reports; ``event_time`` keeps the original for pushed-down ranges."""
    return risk.withColumns({"event_time": F.col("date"), "date": F.to_date("date")})


def write_risk_table(risk: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by month, sorted by date and user within a file, so that row groups hold few days.

    The rebalance hint lets AQE split a month too large for one task.
    """
    by_month = risk.withColumn("event_month", F.date_format("date", "yyyy-MM"))
    by_month.hint("rebalance", "event_month").sortWithinPartitions("event_month", "date", "user").write.mode(mode).partitionBy("event_month").parquet(path)


def open_risk_table(spark: SparkSession, path: str) -> DataFrame:
    """Open a Parquet risk table; date filters prune months and reach the scan."""
    stored = spark.read.option("basePath", path).parquet(path)
    return as_report_table(stored.withColumn("event_month", F.col("event_month").cast("string")))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of headered CSV parts, written by the tasks that hold the rows."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_risk_csv(spark: SparkSession, path: str) -> DataFrame:
    """Open the 20-column CSV export as a report table."""
    schema = ", ".join(f"`{name}` {TEXT_TYPES.get(name, 'DOUBLE')}" for name in EXPORT)
    stored = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return as_report_table(stored.withColumns({name: F.col(name).cast("bigint") for name in MEASURES}))
