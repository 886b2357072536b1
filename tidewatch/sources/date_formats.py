"""Logs whose files write dates in different formats.

Every file votes: a format gets one vote per date of the file that it can read. The format with the
most votes is the file's. Where two formats have the most and read some date differently (01/02/2024),
nothing in the file decides, and it is named instead of guessed at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import parse

# The usual ways of activity logs to write a moment.
FORMATS = ("MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")


def vote(dates: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """(file, format, dates, votes, problem) from (file, raw_date): one aggregation over all files.

    ``problem`` is NULL for a decided file, 'ambiguous' where formats tie with different readings, and
    'unreadable' where no date of a file with dates can be read. A file without dates has no format
    and no problem.
    """
    read = [parse(F.col("raw_date"), f) for f in formats]
    named = dates.select("file", "raw_date", *(r.alias(f"_r{i}") for i, r in enumerate(read)))
    votes = [F.count(f"_r{i}").alias(f"_v{i}") for i in range(len(formats))]
    pairs = [(i, j) for i in range(len(formats)) for j in range(i)]
    differ = [F.count_if(F.col(f"_r{i}") != F.col(f"_r{j}")).alias(f"_d{i}_{j}") for i, j in pairs]
    found = named.groupBy("file").agg(F.count("raw_date").alias("dates"), *votes, *differ)
    top = reduce(F.greatest, [F.col(f"_v{i}") for i in range(1, len(formats))], F.col("_v0"))
    leads = [(F.col("votes") > 0) & (F.col(f"_v{i}") == F.col("votes")) for i in range(len(formats))]
    tie = reduce(lambda a, b: a | b, [leads[i] & leads[j] & (F.col(f"_d{i}_{j}") > 0) for i, j in pairs], F.lit(False))
    best = reduce(lambda rest, i: F.when(leads[i], formats[i]).otherwise(rest), reversed(range(len(formats))), F.lit(None).cast("string"))
    problem = F.when((F.col("dates") > 0) & (F.col("votes") == 0), "unreadable").when(tie, "ambiguous")
    return found.withColumn("votes", top).select(
        "file", F.when(problem.isNull(), best).alias("format"), "dates", "votes", problem.alias("problem")
    )


def read_by(formats: Sequence[str]) -> Column:
    """The moment that ``raw_date`` means in its file's ``format``."""
    tries = [F.when(F.col("format") == f, parse(F.col("raw_date"), f)) for f in formats]
    return F.coalesce(*tries)
