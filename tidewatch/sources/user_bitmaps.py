"""Exact distinct users of any date range from stored bitmaps.

Users get dense numbers once. Each day keeps, per risk level, the numbers of its users as bitmaps of
32,768 bits. A range is answered by OR-ing its days' bitmaps and counting bits: exact, additive over days
and loads, and without a look at the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def number_users(users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user, number): dense numbers from 0; those already ``known`` keep theirs and new ones follow.

    Users are counted per partition and numbered where they lie, so no task sees them all. What comes
    to the driver is a count per partition.
    """
    found = users.select("user").where("user is not null").distinct()
    start = 0
    if known is not None:
        known = known.select("user", "number")
        found = found.join(known, "user", "left_anti")
        start = (known.agg(F.max("number")).first()[0] or -1) + 1 if not known.isEmpty() else 0
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stage(found.select("user", F.spark_partition_id().alias("p"), at.alias("at")), "new-users")
    offsets = []
    for p, n in sorted((r.p, r.n) for r in placed.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((p, start))
        start += n
    places = placed.sparkSession.createDataFrame(offsets, "p int, first bigint")
    numbered = placed.join(places, "p").select("user", (F.col("first") + F.col("at")).alias("number"))
    return numbered if known is None else known.unionByName(numbered)


def daily_bitmaps(risk: DataFrame, numbers: DataFrame) -> DataFrame:
    """(date, risk_level, bucket, users): the users of each day and level as bitmaps.

    A user's rows of a day and level are one row before anything is joined.
    """
    seen = risk.select("user", F.to_date("date").alias("date"), "risk_level").where("user is not null").distinct()
    numbered = seen.join(numbers, "user")
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("users")
    return numbered.groupBy("date", "risk_level", bucket).agg(bits)


def distinct_users(bitmaps: DataFrame, ranges: Sequence[tuple[str, date | None, date | None]]) -> DataFrame:
    """(label, total_unique_users, high_risk_users) of inclusive date ranges, open where None."""
    spans = F.array(
        *(
            F.struct(F.lit(label).alias("label"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
            for label, start, end in ranges
        )
    )
    held = F.filter(
        spans,
        lambda s: (s["start"].isNull() | (F.col("date") >= s["start"])) & (s["end"].isNull() | (F.col("date") <= s["end"])),
    )
    rows = bitmaps.select(F.explode(F.transform(held, lambda s: s["label"])).alias("label"), "risk_level", "bucket", "users")
    high = F.when(F.col("risk_level") == "High", F.col("users"))
    merged = rows.groupBy("label", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("users")).alias("every"),
        F.bitmap_count(F.bitmap_or_agg(F.coalesce(high, F.lit(b"")))).alias("high"),
    )
    counted = merged.groupBy("label").agg(F.sum("every").alias("total_unique_users"), F.sum("high").alias("high_risk_users"))
    labels = bitmaps.sparkSession.createDataFrame([(r[0],) for r in ranges], "label string")
    return labels.join(counted, "label", "left").fillna(0)
