"""A stream whose late rows correct closed windows instead of being lost.

Each micro-batch is split by the watermark that held before it: rows of windows still open go on,
rows of closed windows go to a side table. Both are kept aggregated, one folder per batch id, so a batch that
is repeated after a failure overwrites itself. Measures are additive: a window's corrected value is
its closed value plus its late parts.

    marks/batch=<id>       the latest event time of the batch
    on_time/batch=<id>     user, date, measures of the rows in time
    late/batch=<id>        the same of late rows, with how many they were and how late at most
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import truncate
from ..operators.activity import activity_measures
from ..schema import KEYS
from ..session import require_utc
from ..sources.activity_store import ADDITIVE, added_up
from ..sources.events import tag_events


@dataclass(frozen=True)
class LateAwareActivity:
    """Activity per user and day of an event stream under ``path``."""

    spark: SparkSession
    path: str
    user_type: str = "bigint"
    delay: timedelta = timedelta(days=1)

    def _read(self, table: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{table}"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(folder)

    def _activity(self, table: str, extra: str = "") -> DataFrame:
        kinds = {"http_bytes_sent": "double"}
        measures = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ADDITIVE)
        return self._read(table, f"user {self.user_type}, date timestamp_ntz, {measures}{extra}")

    def watermark(self, before: int | None = None) -> datetime | None:
        """The latest event time of all batches, or of those before one, less the delay."""
        marks = self._read("marks", "latest timestamp_ntz")
        if before is not None:
            marks = marks.where(F.col("batch") < before)
        latest = marks.agg(F.max("latest")).first()[0]
        return latest - self.delay if latest else None

    def take(self, events: DataFrame, batch: int) -> None:
        """Take in one micro-batch; the same id again replaces what it wrote."""
        log = tag_events(events, "raw").where(F.col("user").isNotNull() & F.col("date").isNotNull())
        mark = self.watermark(before=batch)
        day = truncate(F.col("date"), "day")
        closed = F.lit(False) if mark is None else day + F.expr("INTERVAL 1 DAY") <= F.lit(mark).cast("timestamp_ntz")
        rows = log.withColumns({"moment": F.col("date"), "late": closed}).withColumn("date", day)
        found = rows.groupBy(*KEYS, "late").agg(
            *activity_measures(log), F.count(F.lit(1)).alias("n_late"), F.min("moment").alias("earliest"), F.max("moment").alias("latest")
        )
        found.persist()
        try:
            self._write(found.agg(F.max("latest").alias("latest")), "marks", batch)
            self._write(found.where("not late").select(*KEYS, *ADDITIVE), "on_time", batch)
            micros = lambda t: F.unix_micros(t.cast("timestamp"))
            behind = F.lit(0.0) if mark is None else (micros(F.lit(mark)) - micros(F.col("earliest"))) / 1e6
            late = found.where("late").select(*KEYS, *ADDITIVE, "n_late", behind.alias("seconds_late"))
            self._write(late, "late", batch)
        finally:
            found.unpersist()

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def run(self, stream: DataFrame, checkpoint: str | None = None) -> None:
        """Work off all that is available of an event stream; a later run goes on behind it."""
        require_utc(self.spark)
        query = (
            stream.writeStream.foreachBatch(lambda events, batch: self.take(events, batch))
            .option("checkpointLocation", checkpoint or f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def closed(self) -> DataFrame:
        """Windows behind the watermark, as they were when they closed: without late rows."""
        mark = self.watermark()
        parts = self._activity("on_time")
        return added_up(parts.where(F.col("date") + F.expr("INTERVAL 1 DAY") <= F.lit(mark).cast("timestamp_ntz")))

    def late(self) -> DataFrame:
        """The side table: late rows by user, date and batch."""
        return self._activity("late", ", n_late bigint, seconds_late double")

    def corrected(self) -> DataFrame:
        """All windows, open ones included, with their late rows: the batch answer."""
        return added_up(self._activity("on_time").unionByName(self._activity("late")))
