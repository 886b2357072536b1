"""Report filters as column predicates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MEASURES, SOURCES, SPIKES

SPIKE_LIMIT = 3.0


@dataclass(frozen=True)
class Filters:
    """Optional predicates, all ANDed. An empty one filters nothing.

    ``start`` and ``end`` are inclusive days, either may be open. ``users`` is a
    list or a DataFrame with a ``user`` column, cast to the table's type and matched by
    a semi join at every length. ``spikes`` names spike columns;
    mode 'threshold' keeps z > ``spike_limit``, 'exact' keeps z = 1. ``activity``
    names sources, of which at least one must have been active.
    """

    start: date | None = None
    end: date | None = None
    users: Sequence | DataFrame = ()
    levels: Sequence[str] = ()
    spikes: Sequence[str] = ()
    spike_mode: str = "threshold"
    spike_limit: float = SPIKE_LIMIT
    activity: Sequence[str] = field(default=())

    def __post_init__(self) -> None:
        unknown = [*set(self.spikes) - set(SPIKES), *set(self.activity) - set(SOURCES)]
        if unknown or self.spike_mode not in ("threshold", "exact"):
            raise ValueError(f"unknown filter value: {unknown or self.spike_mode}")

    def _dates(self, columns: Sequence[str]) -> list[Column]:
        """The day range and, on a stored table, the same range on the raw time and month."""
        found: list[Column] = []
        if self.start is not None:
            found.append(F.col("date") >= F.lit(self.start))
            if "event_time" in columns:
                found.append(F.col("event_time") >= _midnight(self.start))
            if "event_month" in columns:
                found.append(F.col("event_month") >= f"{self.start:%Y-%m}")
        if self.end is not None:
            found.append(F.col("date") <= F.lit(self.end))
            if "event_time" in columns:
                found.append(F.col("event_time") < _midnight(self.end + timedelta(days=1)))
            if "event_month" in columns:
                found.append(F.col("event_month") <= f"{self.end:%Y-%m}")
        return found

    def predicate(self, columns: Sequence[str] = ()) -> Column:
        """The conjunction of all predicates but a user semi join."""
        found = self._dates(columns)
        if self.levels:
            found.append(F.col("risk_level").isin(*self.levels))
        for spike in self.spikes:
            z = F.col(spike)
            found.append(z > self.spike_limit if self.spike_mode == "threshold" else z == F.lit(1.0))
        if self.activity:
            counts = dict(zip(SOURCES, MEASURES, strict=True))
            found.append(reduce(or_, [F.col(counts[source]) > 0 for source in self.activity]))
        return reduce(and_, found, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.where(self.predicate(df.columns))
        if isinstance(self.users, DataFrame):
            users = self.users.select("user")
        elif self.users:
            users = df.sparkSession.createDataFrame([(str(u),) for u in self.users], "user STRING")
        else:
            return kept
        kind = df.schema["user"].dataType
        return kept.join(users.select(F.col("user").try_cast(kind).alias("user")), "user", "left_semi")

    def dates_only(self) -> Filters:
        return Filters(start=self.start, end=self.end)


def _midnight(day: date) -> Column:
    return F.lit(day).cast("timestamp_ntz")
