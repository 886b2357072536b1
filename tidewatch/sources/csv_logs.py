"""Adapter for the three CSV logs: logon and device with a header, web without."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import parse
from ..session import require_utc
from ..schema import SOURCES
from .activity_log import tagged_log
from .date_formats import read_by, vote

# Column order of the headerless web log.
HTTP_COLUMNS = ("id", "date", "time", "user", "pc", "url", "content", "bytes_sent", "bytes_received")
BYTES = ("bytes_sent", "bytes_received")
HTTP_SCHEMA = ", ".join(f"`{name}` STRING" for name in HTTP_COLUMNS)

# Texts the usual CSV readers of data-frame libraries take as missing.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

DEFAULT_FORMAT = "MM/dd/yyyy HH:mm:ss"


def _present(name: str) -> Column:
    column = F.col(name)
    return F.when(~column.isin(*MISSING_TEXTS), column)


def _number(name: str) -> Column:
    """A finite DOUBLE; fractions stay, and text that is no number becomes NULL."""
    value = _present(name).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def read_headered(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """All columns as text, named by the header: only its line is read ahead, no types are inferred.

    The files of one path must agree in their header, or the read fails. Paths of a list may
    differ; each is read by its own header and the columns are put together by name.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    frames = [reader.csv(p) for p in _paths(path)]
    frames = [f.withColumn("_file", F.col("_metadata.file_path")) for f in frames]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def read_http(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    reader = spark.read.schema(HTTP_SCHEMA).option("header", False)
    rows = reader.option("escape", '"').option("multiLine", multi_line).csv(_paths(path))
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def _keyed(raw: DataFrame, fmt: str | Sequence[str], numbers: tuple[str, ...] = (), by_folder: bool = False) -> DataFrame:
    """Parsed columns and ``problem``: what could not be read, a column or the dates of the file (or its folder)
    as a whole, NULL for a good row."""
    texts = raw.withColumns({"user": _present("user"), "raw_date": _present("date")})
    unread = F.when(F.col("raw_date").isNotNull() & F.col("date").isNull(), "date")
    if isinstance(fmt, str):
        keyed = texts.withColumn("date", parse(F.col("raw_date"), fmt))
    else:
        voter = F.regexp_replace("_file", "/[^/]*$", "") if by_folder else F.col("_file")
        texts = texts.withColumn("_voter", voter)
        votes = vote(texts.select(F.col("_voter").alias("file"), "raw_date"), fmt)
        votes = votes.select(F.col("file").alias("_voter"), "format", F.col("problem").alias("_undecided"))
        keyed = texts.join(votes, "_voter").withColumn("date", read_by(fmt))
        named = F.concat(F.lit("dates of "), F.col("_voter"), F.lit(": "), F.col("_undecided"))
        unread = F.when(F.col("raw_date").isNotNull() & F.col("_undecided").isNotNull(), named).when(
            F.col("raw_date").isNotNull() & F.col("date").isNull(), "date"
        )
    for name in numbers:
        unread = unread.when(_present(name).isNotNull() & _number(name).isNull(), name)
    return keyed.withColumn("problem", unread)


def read_logs(
    spark: SparkSession,
    logon: str | list[str],
    device: str | list[str],
    http: str | list[str],
    *,
    timestamp_format: str | Sequence[str] = DEFAULT_FORMAT,
    multi_line: bool = False,
    by_folder: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(logon, http, device) with parsed dates. ``raw_*`` keep the text and ``problem`` names an unread
    column for :func:`rejected`.

    With several timestamp formats, every file is read in the one that its own dates vote for. A file that
    cannot be decided is a ``problem`` of its rows, by name. With ``by_folder`` the files of a folder are parts of
    one log in one format and vote together: a part that holds the first days of a month alone decides nothing.

    ``multi_line`` reads quoted line breaks but makes each file one task; leave it
    off for large unsplit files.
    """
    require_utc(spark)
    plain = [
        _keyed(read_headered(spark, path, multi_line), timestamp_format, by_folder=by_folder).select(
            "user", "date", "raw_date", _present("activity").alias("activity"), "problem"
        )
        for path in (logon, device)
    ]
    web = _keyed(read_http(spark, http, multi_line), timestamp_format, BYTES, by_folder).select(
        "user",
        "date",
        "raw_date",
        _present("url").alias("url"),
        *(_number(name).alias(name) for name in BYTES),
        *(F.col(name).alias(f"raw_{name}") for name in BYTES),
        "problem",
    )
    return plain[0], web, plain[1]


def read_tagged(
    spark: SparkSession, logon: str | list[str], device: str | list[str], http: str | list[str],
    rejects: str | None = None, **options,
) -> DataFrame:
    """The tagged log of three CSV paths, with dates as they stand.

    A row with a date or number that cannot be read ends the job that meets it, unless a ``rejects``
    folder is given: then such rows are written there, as JSON with their log, text and problem,
    and left out. What an earlier run left in the folder is replaced.
    """
    frames = read_logs(spark, logon, device, http, **options)
    if rejects is None:
        message = F.concat(F.lit("unreadable "), F.col("problem"), F.lit(" on "), F.coalesce("raw_date", F.lit("an undated row")))
        checked = F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(F.col("date"))
        frames = tuple(f.withColumn("date", checked) for f in frames)
    else:
        rejected_rows(frames).write.mode("overwrite").json(rejects)
        frames = tuple(f.where("problem is null") for f in frames)
    return tagged_log(*frames)


def rejected_rows(frames: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """The rows of all logs that could not be read: log, user, problem and the raw texts."""
    parts = []
    for source, frame in zip(SOURCES, frames, strict=True):
        raw = [F.col(f"raw_{n}") if source == "http" else F.lit(None).cast("string").alias(f"raw_{n}") for n in BYTES]
        parts.append(rejected(frame).select(F.lit(source).alias("log"), "user", "problem", "raw_date", *raw))
    return reduce(DataFrame.unionByName, parts)


def rejected(frame: DataFrame) -> DataFrame:
    """Rows with a date or number whose text could not be read."""
    return frame.where(F.col("problem").isNotNull())
