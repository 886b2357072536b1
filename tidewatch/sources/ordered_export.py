"""An export in one order over all of its parts.

Rows are cut into ranges of the keys by sampled bounds, so each part is one task's work and the parts
follow each other in the order of their names. A manifest beside them names each part's first and last
key, its rows, and how many rows come before it.

    parts/part-*.csv
    manifest/          one row per part, as JSON
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEYS
from .risk_table import write_csv

ROWS_PER_PART = 1_000_000


def write_ordered(df: DataFrame, path: str, keys: tuple[str, ...] = KEYS, parts: int | None = None) -> None:
    """Write ``df`` as CSV parts in the order of ``keys``, nulls first, and their manifest.

    ``parts`` is a number of ranges; a user with a large share of all rows spreads over several of
    them, as the bounds are of all keys together. By default Spark decides.
    """
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    write_csv(ranged.sortWithinPartitions(*keys), f"{path}/parts")
    stored = df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').csv(f"{path}/parts")
    at = F.struct(*keys)
    found = stored.groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows")
    )
    # One row per part: a window over all of them is as long as a folder's listing.
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found.withColumn("rows_before", before).orderBy("part").coalesce(1).write.json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str, schema, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(part, first, last, rows, rows_before) of an ordered export of rows with ``schema``."""
    key = ", ".join(f"{k}: {schema[k].dataType.simpleString()}" for k in keys)
    return spark.read.schema(f"part string, first struct<{key}>, last struct<{key}>, rows bigint, rows_before bigint").json(f"{path}/manifest")


def out_of_order(manifest: DataFrame) -> DataFrame:
    """Parts that begin before the part in front of them ends; none in a sound export."""
    previous = F.lag("last").over(Window.orderBy("part"))
    return manifest.withColumn("previous", previous).where("first < previous or first > last")


def read_ordered(spark: SparkSession, path: str, schema, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of an ordered export with ``row_no``, their place in it from 1.

    A place is the rows before the part plus the place in the part; a part may be read in several pieces,
    whose own places follow from their offsets.
    """
    stored = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{path}/parts")
    part, block = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    rows = stored.select("*", part.alias("_part"), block.alias("_block"), F.monotonically_increasing_id().alias("_at"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_block", "_at"))
    placed = rows.withColumn("_within", within)
    manifest = read_manifest(spark, path, schema, keys).select(F.col("part").alias("_part"), "rows_before")
    numbered = placed.join(manifest, "_part").withColumn("row_no", F.col("rows_before") + F.col("_within"))
    return numbered.drop("_part", "_block", "_at", "_within", "rows_before")


def parts_with(manifest: DataFrame, **wanted) -> DataFrame:
    """The parts that can hold rows whose leading keys have these values."""

    def leading(at: str) -> Column:
        return F.struct(*(F.col(f"{at}.{k}") for k in wanted))

    value = F.struct(*(F.lit(v).alias(k) for k, v in wanted.items()))
    tests = [leading("first") <= value, leading("last") >= value]
    return manifest.where(reduce(lambda a, b: a & b, tests))
