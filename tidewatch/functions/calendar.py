"""Calendar features of a timestamp column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Working hours and weekday names.
FIRST_WORK_HOUR = 7
LAST_WORK_HOUR = 19
WORKING_DAYS = 5
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def calendar_columns(date: Column) -> dict[str, Column]:
    """Year to minute, weekday (Monday = 0), week of month and the two flags."""
    hour, weekday, day = F.hour(date), F.weekday(date), F.dayofmonth(date)
    outside = (hour < FIRST_WORK_HOUR) | (hour > LAST_WORK_HOUR)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": day,
        "weekday": weekday,
        "hour": hour,
        "minute": F.minute(date),
        "is_working_day": (weekday < WORKING_DAYS).cast("int"),
        "week_of_month": (F.floor((day - 1) / 7) + 1).cast("int"),
        "is_off_hours": outside.cast("int"),
    }


def weekday_name(weekday: Column) -> Column:
    """Name of a weekday number; NULL for a number outside 0 to 6."""
    pairs = chain.from_iterable((F.lit(i), F.lit(n)) for i, n in enumerate(WEEKDAY_NAMES))
    return F.element_at(F.create_map(*pairs), weekday)
