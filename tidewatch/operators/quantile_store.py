"""Exact score thresholds kept up to date load by load.

Every load keeps its values, sorted, and a sketch of them: a histogram whose buckets are values
alike in their leading binary digits, with the exact count, least and greatest value of each. Sketches of
loads merge by adding up buckets of the same key, so a wanted rank is bracketed from a few thousand
merged buckets, and only the values inside the bracket are read. Sorted files with small row groups let the
scan skip the rest.

    values/load=<name>    value, in order
    sketch/load=<name>    key, low, high, n
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quantiles import interpolated, values_at

# Buckets per factor of two.
STEPS = 1024
ROW_GROUP_BYTES = 1 << 20


def bucket_key(value: Column) -> Column:
    """The value cut to its leading digits: about three decimal ones."""
    size = F.floor(F.log2(F.abs(value))).cast("double")
    step = F.pow(F.lit(2.0), size) / STEPS
    return F.when(value == 0, F.lit(0.0)).otherwise(F.floor(value / step) * step)


def sketch(values: DataFrame) -> DataFrame:
    """(key, low, high, n) of a ``value`` column; one pass with partial aggregation."""
    grouped = values.groupBy(bucket_key(F.col("value")).alias("key"))
    return grouped.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Bracket:
    """Bounds of a wanted value, how many values lie below them, and how many within."""

    low: float
    high: float
    below: int
    within: int


def bracket(buckets: list[tuple[float, float, int]], rank: int) -> Bracket:
    """The least range of whole buckets that surely holds the value of a rank (from 0).

    ``buckets`` are (low, high, n); their ranges may touch or overlap.
    """
    total = sum(n for _, _, n in buckets)
    high, seen = 0.0, 0
    for _, top, n in sorted(buckets, key=lambda b: b[1]):
        high, seen = top, seen + n
        if seen > rank:  # more than rank values are at most this one
            break
    low, seen = 0.0, 0
    for bottom, _, n in sorted(buckets, key=lambda b: -b[0]):
        low, seen = bottom, seen + n
        if seen >= total - rank:  # at most rank values are below this one
            break
    while True:
        inside = [b for b in buckets if b[0] <= high and b[1] >= low]
        wider = (min(b[0] for b in inside), max(b[1] for b in inside))
        if wider == (low, high):
            break
        low, high = wider
    return Bracket(low, high, sum(n for _, top, n in buckets if top < low), sum(n for *_, n in inside))


@dataclass(frozen=True)
class Quantiles:
    """Values by probability; ``rows`` of the store and ``scanned``, the values the brackets held."""

    values: list[float | None]
    rows: int
    scanned: int


@dataclass(frozen=True)
class QuantileStore:
    spark: SparkSession
    path: str

    def add(self, load: str, values: DataFrame) -> None:
        """Keep the ``value`` column of a load, NULL and NaN left out; the same name again replaces it."""
        kept = values.select(F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
        # Ranges in order, so that a bracket lies in few files and row groups.
        ordered = kept.repartitionByRange("value").sortWithinPartitions("value")
        ordered.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/values/load={load}")
        stored = self.spark.read.schema("value double").parquet(f"{self.path}/values/load={load}")
        sketch(stored).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sketch/load={load}")

    def quantiles(self, probs: list[float]) -> Quantiles:
        """Linear-interpolation quantiles of all loads, exact."""
        stored = self.spark.read.schema("key double, low double, high double, n bigint, load string").parquet(f"{self.path}/sketch")
        merged = stored.groupBy("key").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
        buckets = [tuple(r[1:]) for r in merged]  # some thousands, by the spread of the values and not their number
        rows = sum(b[2] for b in buckets)
        if not rows:
            return Quantiles([None] * len(probs), 0, 0)
        ranks = sorted({r for p in probs for r in (floor(p * (rows - 1)), ceil(p * (rows - 1)))})
        brackets = {rank: bracket(buckets, rank) for rank in ranks}
        names = {b: f"v{i}" for i, b in enumerate(dict.fromkeys(brackets.values()))}
        inside = {b: (F.col("value") >= b.low) & (F.col("value") <= b.high) for b in names}
        values = self.spark.read.schema("value double, load string").parquet(f"{self.path}/values")
        read = values.where(reduce(or_, inside.values())).select(*(F.when(inside[b], F.col("value")).alias(n) for b, n in names.items()))
        wanted = {(names[b], rank - b.below) for rank, b in brackets.items()}
        found = values_at(read, {n: b.within for b, n in names.items()}, wanted)
        by_rank = {("value", rank): found[names[b], rank - b.below] for rank, b in brackets.items()}
        return Quantiles([interpolated(by_rank, "value", rows, p) for p in probs], rows, sum(b.within for b in names))
