"""A copy of the risk table laid out by user, and the files a drill-down has to open.

Within a month, rows are cut into ranges of the user, so a user's rows lie in one file, or in a few
if they are many. An index keeps each file's users, and a drill-down opens the files it names; a
Parquet Bloom filter on the user lets a scan that knows no index skip row groups as well.

    rows/event_month=<yyyy-MM>/*.parquet
    index/                                  user, file
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .risk_table import as_report_table

ROW_GROUP_BYTES = 8 << 20
USERS_A_FILE = 100_000  # sizes the Bloom filter: about a bit and a half per byte of user at 1 % error


def write_by_user(risk: DataFrame, path: str, files: int | None = None) -> None:
    """Write the copy and its index. ``files`` is the number of ranges over all months and users."""
    month = risk.withColumn("event_month", F.date_format("date", "yyyy-MM"))
    keys = ("event_month", "user", "date")
    ranged = month.repartitionByRange(files, *keys) if files else month.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.partitionBy("event_month")
    writer = writer.option("parquet.bloom.filter.enabled#user", "true").option("parquet.bloom.filter.expected.ndv#user", USERS_A_FILE)
    # Parquet writes no such filter for a column that a dictionary holds whole.
    writer = writer.option("parquet.enable.dictionary#user", "false")
    writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/rows")
    stored = risk.sparkSession.read.parquet(f"{path}/rows")
    pairs = stored.select("user", F.col("_metadata.file_path").alias("file")).distinct()
    pairs.repartitionByRange("user").sortWithinPartitions("user").write.parquet(f"{path}/index")


def files_of(spark: SparkSession, path: str, users: DataFrame | Sequence) -> list[str]:
    """The files that hold rows of the users, by the index."""
    index = spark.read.parquet(f"{path}/index")
    if not isinstance(users, DataFrame):
        users = spark.createDataFrame([(str(u),) for u in users], "user string")
    wanted = users.select(F.col("user").try_cast(index.schema["user"].dataType).alias("user"))
    # File names, as Spark's own listing holds for every scan.
    return sorted(r.file for r in index.join(wanted, "user", "left_semi").select("file").distinct().collect())


def open_for_users(spark: SparkSession, path: str, users: DataFrame | Sequence) -> DataFrame:
    """The report table cut to the files of the users; filter it by user as usual."""
    everything = spark.read.parquet(f"{path}/rows")
    files = files_of(spark, path, users)
    kept = spark.read.schema(everything.schema).option("basePath", f"{path}/rows").parquet(*files) if files else everything.limit(0)
    return as_report_table(kept.withColumn("event_month", F.col("event_month").cast("string")))
