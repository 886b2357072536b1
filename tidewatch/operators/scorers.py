"""The scorer interface and the z-score scorer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SPIKES

SCORE_DIGITS = 6


class Model(Protocol):
    def transform(self, features: DataFrame) -> DataFrame:
        """Add ``raw_score``, higher = more unusual."""
        ...


class Scorer(Protocol):
    """A way to score rows. ``centred`` scorers put the contamination cut at risk 0."""

    centred: bool

    def fit(self, features: DataFrame) -> Model: ...


@dataclass(frozen=True)
class ZScore:
    """Sum of the absolute spikes, a missing spike as 0. Nothing to fit."""

    centred: bool = False

    def fit(self, features: DataFrame) -> ZScore:
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        parts = [F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in SPIKES]
        return features.withColumn("raw_score", F.round(reduce(add, parts), SCORE_DIGITS))
