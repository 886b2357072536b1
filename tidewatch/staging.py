"""Staged tables: intermediate results written once to the shared folder.

A staged table cuts the lineage (a lost executor re-reads files instead of
repeating the shuffles), keeps column pruning and filter pushdown, and lets the
several passes of scoring and thresholding share one scan of the raw logs.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return context.getCheckpointDir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for this application, never reused."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tidewatch/{app}/{name}-{uuid4().hex}"


def stage_counted(
    df: DataFrame, name: str = "stage", file_rows: int | None = None, counted: str | None = None
) -> tuple[DataFrame, int]:
    """Write ``df`` as Parquet to the shared folder; the table read back and its row count.

    The count is observed while writing and costs no job of its own; with ``counted`` it is that of the
    column's values. ``file_rows`` bounds the rows of a file: where a row takes much work and few bytes, a
    small file is then still a task of its own.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    seen = Observation()
    writer = df.observe(seen, F.count(F.col(counted) if counted else F.lit(1)).alias("rows")).write
    (writer.option("maxRecordsPerFile", file_rows) if file_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def stage(df: DataFrame, name: str = "stage", file_rows: int | None = None) -> DataFrame:
    return stage_counted(df, name, file_rows)[0]
