"""Standardisation of the model vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES

# Significant digits kept of fractional features by :func:`steady_vector`.
DIGITS = 12
WHOLE = (
    "logon_count", "http_requests", "device_activity_count",
    "hour", "weekday", "is_working_day", "is_off_hours",
)


def model_vector(names: tuple[str, ...] = FEATURES) -> list[Column]:
    """The features as DOUBLE, a missing spike as 0 (no deviation)."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]


def steady_vector(names: tuple[str, ...] = FEATURES) -> list[Column]:
    """The model vector to twelve significant digits: the last bit of a sum depends on the order
    of its parts and must not flip a tree's split. ``rint`` stays in double arithmetic."""
    vector = model_vector(names)
    return [x if c in WHOLE else _steady(x).alias(c) for c, x in zip(names, vector, strict=True)]


def _steady(x: Column) -> Column:
    power = F.least(F.lit(DIGITS + 300.0), F.lit(float(DIGITS - 1)) - F.floor(F.log10(F.abs(x))))
    # Whole powers of ten are exact up to 10^22; beyond, the same rounding happens on every machine.
    scale = F.pow(F.lit(10.0), F.abs(power))
    rounded = F.when(power >= 0, F.rint(x * scale) / scale).otherwise(F.rint(x / scale) * scale)
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(rounded)


@dataclass(frozen=True)
class FeatureScaler:
    """Zero mean and unit population deviation per column."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def fit(cls, features: DataFrame, names: tuple[str, ...] = FEATURES) -> FeatureScaler:
        """One aggregation; a constant column is divided by 1."""
        stats = [f(c) for c in names for f in (F.avg, F.stddev_pop)]
        row = features.select(*model_vector(names)).agg(*stats).first()
        means, stds = row[0::2], row[1::2]
        return cls(names, tuple(m or 0.0 for m in means), tuple(s or 1.0 for s in stds))

    def columns(self) -> list[Column]:
        vector = model_vector(self.names)
        return [
            ((x - F.lit(m)) / F.lit(s)).alias(c)
            for c, x, m, s in zip(self.names, vector, self.means, self.stds, strict=True)
        ]

    def transform(self, features: DataFrame) -> DataFrame:
        """Keys and scaled columns."""
        return features.select("user", "date", *self.columns())
