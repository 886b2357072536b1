"""Reading tables, cutting Arrow batches into bounded pieces, and counting words natively."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch import staging
from tidewatch.staging import stage_path

__all__ = ["PIECE_CHARS", "arrow_map", "brief_shuffles", "pieces", "stage", "stage_path", "table", "word_count"]

# Characters of text one vectorised step works on; long texts come alone.
PIECE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; the path is read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# Spark's setting to remove the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a write removes its shuffle files when it is done: what follows reads the table written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and opened again, its shuffle files gone."""
    with brief_shuffles(df.sparkSession):
        return staging.stage(df, name)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most`` bytes of ``text``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def arrow_map(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """Apply ``work`` to bounded pieces of every partition; it returns a column per schema field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            yield pa.RecordBatch.from_pydict(work(piece), schema=target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the five ASCII blanks; null and empty text have none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
