"""Spikes and rolling means per user and day, kept as state of the stream.

The batch features compare a day with the user's whole history. Here a day is compared with the
user's history up to and including it, which the stream itself remembers: per user the running
moments of the three counts and the last logon counts, and the days that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.features import ROLLING_ROWS
from ..schema import MEASURES, SPIKES
from ..session import require_utc
from ..sources.events import tag_events

DAY_MS = 86_400_000
_EPOCH = datetime(1970, 1, 1)
_COUNTS = "logon_count LONG, http_requests LONG, device_activity_count LONG"


def daily_counts(events: DataFrame) -> DataFrame:
    """(user, day, counts, event_time) of every piece of a batch: a map-side combine.

    A user's rows of a day leave a task as one row per Arrow batch, so a user with a large share of
    all events does not flood the task that holds their state. ``event_time`` is the latest of them.
    """
    log = tag_events(events, "raw").where(F.col("user").isNotNull() & F.col("date").isNotNull())
    hits = [F.when(F.col("source") == s, F.when(F.col("item").isNotNull(), 1)).otherwise(0).cast("long") for s in ("logon", "http", "device")]
    day = F.unix_date(F.to_date("date")).cast("long")
    rows = log.select("user", day.alias("day"), F.unix_micros(F.col("date").cast("timestamp")).alias("at"), *(h.alias(c) for h, c in zip(hits, MEASURES, strict=True)))

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            how = {"at": "max"} | dict.fromkeys(MEASURES, "sum")
            yield frame.groupby(["user", "day"], as_index=False).agg(how)[["user", "day", "at", *MEASURES]]

    kind = rows.schema["user"].dataType.simpleString()
    combined = rows.mapInPandas(combine, f"user {kind}, day LONG, at LONG, {_COUNTS}")
    return combined.withColumn("event_time", F.timestamp_micros("at")).drop("at")


class Moments:
    """Running count, means and squared deviations of the three counts, and the last logon counts."""

    def __init__(self, packed: tuple | None = None):
        self.n, self.means, self.squares, self.last = (0, [0.0] * 3, [0.0] * 3, []) if packed is None else (packed[0], list(packed[1]), list(packed[2]), list(packed[3]))

    def packed(self) -> tuple:
        return self.n, self.means, self.squares, self.last

    def add(self, counts: tuple[int, ...]) -> dict:
        """Take in one day; its spikes, rolling mean and delta."""
        self.n += 1
        self.last = [*self.last, counts[0]][-ROLLING_ROWS:]
        out = {}
        for i, (spike, x) in enumerate(zip(SPIKES, counts, strict=True)):
            shift = x - self.means[i]
            self.means[i] += shift / self.n
            self.squares[i] += shift * (x - self.means[i])
            spread = sqrt(self.squares[i] / (self.n - 1)) if self.n > 1 else 0.0
            out[spike] = (x - self.means[i]) / spread if spread > 0 else None
        rolling = sum(self.last) / len(self.last)
        return out | {"logon_rolling_3": rolling, "logon_delta": counts[0] - rolling}


OUTPUT = f"date TIMESTAMP_NTZ, {_COUNTS}, logon_spike DOUBLE, http_spike DOUBLE, device_spike DOUBLE, logon_rolling_3 DOUBLE, logon_delta DOUBLE, days LONG"


# Per user: the open days with their three counts in a row, and the moments however long the history is.
STATE = "days ARRAY<LONG>, counts ARRAY<LONG>, n LONG, means ARRAY<DOUBLE>, squares ARRAY<DOUBLE>, last ARRAY<LONG>"


def _advance(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add up a user's open days, and close those that the watermark has passed."""
    mark = state.getCurrentWatermarkMs()
    held, moments = {}, None
    if state.exists:
        days, counts, *packed = state.get
        held = {day: list(counts[i * 3 : i * 3 + 3]) for i, day in enumerate(days)}
        moments = tuple(packed)
    if not state.hasTimedOut:
        for frame in rows:
            for day, *counts in zip(*(frame[c].tolist() for c in ("day", *MEASURES)), strict=True):
                if (day + 1) * DAY_MS > mark:  # a closed day takes nothing more
                    held[day] = [a + b for a, b in zip(held.get(day, (0, 0, 0)), counts, strict=True)]
    history = Moments(moments)
    due = sorted(day for day in held if (day + 1) * DAY_MS <= mark)
    out = []
    for day in due:
        counts = held.pop(day)
        found = history.add(tuple(counts))
        out.append({"user": key[0], "date": _EPOCH + timedelta(days=day), **dict(zip(MEASURES, counts, strict=True)), **found, "days": history.n})
    state.update(([*held], [c for counts in held.values() for c in counts], *history.packed()))
    if held:  # the next day to close wakes the user up
        state.setTimeoutTimestamp((min(held) + 1) * DAY_MS)
    if out:
        columns = {name: [row[name] for row in out] for name in out[0]}
        # A missing spike is NaN here and NULL in the table.
        yield pd.DataFrame(columns | {name: np.array(columns[name], dtype=float) for name in SPIKES})


def user_history(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per user and closed day of an event stream, in append mode: counts, spikes against the
    running mean and deviation, rolling mean, delta, and ``days``, how many days of the user are known.

    Rows without user or time are left out, and rows of a day already closed are dropped as late. A
    spike is NULL while the deviation is unknown or zero. Any state store will do: a user's state is one
    value, read and written once a batch.
    """
    require_utc(events.sparkSession)
    counts = daily_counts(events).withWatermark("event_time", delay)
    kind = counts.schema["user"].dataType.simpleString()
    return counts.groupBy("user").applyInPandasWithState(
        _advance, f"user {kind}, {OUTPUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
