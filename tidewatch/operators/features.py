"""Behaviour features of the merged activity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..functions.timestamps import truncate
from ..schema import MEASURES, SPIKES

ROLLING_ROWS = 3


def user_baseline(activity: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the three counts per user."""
    stats = [
        stat(c).alias(f"{c}_{name}")
        for c in MEASURES
        for name, stat in (("mean", F.avg), ("std", F.stddev_samp))
    ]
    return activity.groupBy("user").agg(*stats)


def _history_by_window(activity: DataFrame) -> DataFrame:
    """Baseline and rolling mean from one shuffle and one sort by user and date."""
    by_user = W.partitionBy("user")
    trailing = by_user.orderBy("date").rowsBetween(1 - ROLLING_ROWS, 0)
    columns = {"logon_rolling_3": F.avg("logon_count").over(trailing)}
    for c in MEASURES:
        columns[f"{c}_mean"] = F.avg(c).over(by_user)
        columns[f"{c}_std"] = F.stddev_samp(c).over(by_user)
    return activity.withColumns(columns)


def _history_by_chunk(activity: DataFrame, chunk: str) -> DataFrame:
    """The same columns when one user may hold a large part of all rows.

    Rows are windowed within (user, chunk of time). What a chunk needs from outside
    is small: the last two counts before it and the moments of the user. Both come
    from one row per chunk and are joined back on (user, chunk), so no task ever
    holds the whole history of a user.
    """
    inside = W.partitionBy("user", "chunk").orderBy("date")
    rows = activity.withColumn("chunk", truncate(F.col("date"), chunk)).withColumns(
        {
            "back_1": F.lag("logon_count", 1).over(inside),
            "back_2": F.lag("logon_count", 2).over(inside),
            "position": F.row_number().over(inside),
        }
    )

    moments = [F.count(F.lit(1)).alias("n")]
    for c in MEASURES:
        moments += [F.avg(c).alias(f"{c}_m"), (F.var_pop(c) * F.count(c)).alias(f"{c}_ss")]
    chunks = rows.groupBy("user", "chunk").agg(
        F.max(F.struct("date", "logon_count", "back_1")).alias("tail"), *moments
    )

    by_user = W.partitionBy("user")
    in_order = by_user.orderBy("chunk")
    before = F.array_compact(
        F.array(
            *(
                F.lag(F.col(f"tail.{field}"), distance).over(in_order)
                for distance in (2, 1)
                for field in ("back_1", "logon_count")
            )
        )
    )
    total = F.sum("n").over(by_user)
    chunks = chunks.withColumns(
        {"before": before, "total": total}
        | {f"{c}_mean": F.sum(F.col("n") * F.col(f"{c}_m")).over(by_user) / total for c in MEASURES}
    )
    spread = {}
    for c in MEASURES:
        shift = F.col(f"{c}_m") - F.col(f"{c}_mean")
        squares = F.sum(F.col(f"{c}_ss") + F.col("n") * shift * shift).over(by_user)
        spread[f"{c}_std"] = F.when(F.col("total") > 1, F.sqrt(squares / (F.col("total") - 1)))
    chunks = chunks.withColumns(spread).select(
        "user", "chunk", "before", *(f"{c}_{s}" for c in MEASURES for s in ("mean", "std"))
    )

    last, second_last = (F.try_element_at("before", F.lit(i)) for i in (-1, -2))
    back_1 = F.when(F.col("position") == 1, last).otherwise(F.col("back_1"))
    back_2 = (
        F.when(F.col("position") == 1, second_last)
        .when(F.col("position") == 2, last)
        .otherwise(F.col("back_2"))
    )
    present = F.lit(1) + back_1.isNotNull().cast("int") + back_2.isNotNull().cast("int")
    summed = F.col("logon_count") + F.coalesce(back_1, F.lit(0)) + F.coalesce(back_2, F.lit(0))
    return (
        rows.join(chunks, ["user", "chunk"])
        .withColumn("logon_rolling_3", summed / present)
        .drop("chunk", "back_1", "back_2", "position", "before")
    )


def with_history(activity: DataFrame, chunk: str | None = None) -> DataFrame:
    """Add per-user ``*_mean``, ``*_std`` and ``logon_rolling_3``.

    At the hour or day grain the calendar bounds a user to 8,784 or 366 rows a
    year, so windows by user are safe however many raw events the user has. At the
    raw grain nothing bounds them: pass ``chunk``, best 'minute'. A task then holds
    one minute of a user, and a user has at most 527,040 chunks a year.
    """
    return _history_by_chunk(activity, chunk) if chunk else _history_by_window(activity)


def spike_columns() -> dict[str, Column]:
    """z-scores; NULL where the deviation is unknown (one row) or zero (constant user)."""
    return {
        spike: F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std"))
        for spike, c in zip(SPIKES, MEASURES, strict=True)
    }


def ratio_columns() -> dict[str, Column]:
    requests = F.col("http_requests") + 1
    return {
        "device_http_ratio": F.col("device_activity_count") / requests,
        "logon_http_ratio": F.col("logon_count") / requests,
    }


def missing_flag_columns() -> dict[str, Column]:
    flags = {"http_missing": "http_requests", "device_missing": "device_activity_count", "logon_missing": "logon_count"}
    return {flag: (F.col(c) == 0).cast("int") for flag, c in flags.items()}


def behaviour_features(activity: DataFrame, chunk: str | None = None) -> DataFrame:
    """All feature columns; a caller's ``select`` prunes the ones it does not use."""
    return with_history(activity, chunk).withColumns(
        {
            "logon_delta": F.col("logon_count") - F.col("logon_rolling_3"),
            **spike_columns(),
            **ratio_columns(),
            **calendar_columns(F.col("date")),
            **missing_flag_columns(),
        }
    )
