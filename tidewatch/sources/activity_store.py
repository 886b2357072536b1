"""A store of daily activity that grows by loads.

The five measures are additive, so a load is aggregated on its own and kept as a *part*; the merged
table is the sum of all parts. Adding a load reads that load and the stored parts of the days it
touches, never the raw history. Parts and merged days are written by load name and by day, so
repeating a load, or a retry after a crash anywhere, changes nothing.

    parts/load=<name>/day=<date>    one row per user and date
    merged/day=<date>               the sum over all parts of the day
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import truncate
from ..operators.activity import merged_activity
from ..schema import KEYS, MEASURES

ADDITIVE = (*MEASURES[:2], "http_bytes_sent", "http_bytes_received", MEASURES[2])


def added_up(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts summed per user and date. A measure is 0 where a part has no rows of its log."""
    return parts.groupBy(*KEYS, *keys).agg(*(F.sum(c).alias(c) for c in ADDITIVE))


@dataclass(frozen=True)
class ActivityStore:
    """The store under ``path``, at one grain. ``user_type`` is the type of the users in it."""

    spark: SparkSession
    path: str
    user_type: str = "bigint"
    grain: str = "hour"
    bytes_received_type: str = "bigint"

    @property
    def _schema(self) -> str:
        kinds = {"http_bytes_sent": "double", "http_bytes_received": self.bytes_received_type}
        return f"user {self.user_type}, date timestamp_ntz, " + ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ADDITIVE)

    def _place(self, folder: str):
        """The folder's file system and path."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _read(self, folder: str, schema: str) -> DataFrame:
        system, place = self._place(folder)
        if not system.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def parts(self) -> DataFrame:
        return self._read("parts", f"{self._schema}, load string, day date")

    def merged(self) -> DataFrame:
        """User, date and measures of all loads; ``day`` is a partition column for date filters."""
        return self._read("merged", f"{self._schema}, day date")

    def add(self, load: str, log: DataFrame) -> None:
        """Take in a tagged log under a name; the same name again replaces that load."""
        activity = merged_activity(log.withColumn("date", truncate(F.col("date"), self.grain)))
        # What an earlier form of this load holds is noted first: should it hold days that the new one
        # lacks, they are merged anew even if the job is lost half way and repeated.
        pending = f"pending/load={load}"
        earlier = self.parts().where(F.col("load") == load).select("day").union(self._read(pending, "day date")).distinct()
        days = [r.day for r in earlier.collect()]  # at most the calendar days of one load
        self.spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{pending}")
        dated = activity.select(*KEYS, *ADDITIVE, F.to_date("date").alias("day"))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/parts/load={load}")
        self._merge(load, days)
        system, place = self._place(pending)
        system.delete(place, True)

    def _merge(self, load: str, days: list) -> None:
        """Write anew the merged days that the load touches or touched before."""
        parts = self.parts()
        noted = self.spark.createDataFrame([(d,) for d in days], "day date")
        touched = parts.where(F.col("load") == load).select("day").union(noted).distinct()
        # ``day`` is a partition column: the semi join prunes parts when it runs.
        changed = added_up(parts.join(touched, "day", "left_semi"), "day")
        writer = changed.select(*KEYS, *ADDITIVE, "day").write.mode("overwrite").partitionBy("day")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/merged")
        if days:
            left = {r.day for r in parts.join(noted, "day", "left_semi").select("day").distinct().collect()}
            for day in set(days) - left:
                system, place = self._place(f"merged/day={day}")
                system.delete(place, True)
