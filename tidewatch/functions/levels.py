"""Risk levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RISK_LEVELS


def risk_level(score: Column, medium: float, high: float) -> Column:
    """Low below ``medium``, Medium below ``high``, else High (also for a missing score)."""
    low_name, medium_name, high_name = RISK_LEVELS
    return (
        F.when(score < F.lit(medium), low_name)
        .when(score < F.lit(high), medium_name)
        .otherwise(high_name)
    )


def level_rank(level: Column) -> Column:
    """1, 2, 3 for the known levels and 4 for any other."""
    rank = F.lit(len(RISK_LEVELS) + 1)
    for position, name in reversed(list(enumerate(RISK_LEVELS, start=1))):
        rank = F.when(level == name, position).otherwise(rank)
    return rank
