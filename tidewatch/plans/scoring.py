"""From an activity log to the risk table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import risk_level
from ..functions.timestamps import truncate
from ..operators.activity import merged_activity
from ..operators.features import behaviour_features
from ..operators.quantiles import exact_quantiles
from ..operators.scorers import Scorer, ZScore
from ..schema import CONTAMINATION, EXPORT, FEATURES, HIGH_QUANTILE, KEYS, MEDIUM_QUANTILE
from ..staging import stage, stage_counted


# Rows of a staged feature file: a forest spends some 20 microseconds on a row of a hundred bytes.
WORK_ROWS = 20_000


@dataclass(frozen=True)
class Thresholds:
    """Cuts on ``raw_score``; ``offset`` is subtracted to give ``risk_score``."""

    anomaly: float
    medium: float
    high: float
    offset: float = 0.0


@dataclass(frozen=True)
class Scored:
    """Staged scores, the cuts found on them, and the model that made them."""

    frame: DataFrame
    thresholds: Thresholds
    model: object


def features_of(log: DataFrame, grain: str) -> DataFrame:
    """Feature table of a tagged log, whose dates are truncated to ``grain`` here.

    At the raw grain the merged table is staged, because it is read once for the
    rows and once for the chunk summaries.
    """
    activity = merged_activity(log.withColumn("date", truncate(F.col("date"), grain)))
    if grain == "raw":
        return behaviour_features(stage(activity, "activity"), chunk="minute")
    return behaviour_features(activity)


def find_thresholds(scored: DataFrame, contamination: float, centred: bool, size: int | None = None) -> Thresholds:
    """Level and contamination cuts as exact quantiles of a staged ``raw_score`` with ``size`` values."""
    probs = [1.0 - contamination, MEDIUM_QUANTILE, HIGH_QUANTILE]
    sizes = None if size is None else {"raw_score": size}
    found = exact_quantiles(scored, ["raw_score"], probs, sizes=sizes)["raw_score"]
    cuts = [c if c is not None else 0.0 for c in found]
    return Thresholds(*cuts, offset=cuts[0] if centred else 0.0)


def with_levels(scored: DataFrame, cuts: Thresholds) -> DataFrame:
    """Add ``risk_score``, ``anomaly_score``, ``anomaly`` and ``risk_level``."""
    raw = F.col("raw_score")
    return (
        scored.withColumn("risk_score", raw - F.lit(cuts.offset))
        .withColumn("anomaly_score", -F.col("risk_score"))
        .withColumn("anomaly", F.when(raw > F.lit(cuts.anomaly), -1).otherwise(1))
        .withColumn("risk_level", risk_level(raw, cuts.medium, cuts.high))
    )


def score_features(
    features: DataFrame,
    scorer: Scorer | None = None,
    contamination: float = CONTAMINATION,
    keep: Sequence[str] = (*KEYS, *FEATURES),
) -> Scored:
    """Fit, score, stage and level.

    ``keep`` lists the columns carried along; what a report does not need is not
    even read from the logs. A scorer that fits in several passes should get staged
    ``features``.
    """
    scorer = scorer or ZScore()
    model = scorer.fit(features)
    scored, size = stage_counted(model.transform(features).select(*keep, "raw_score"), "scores", counted="raw_score")
    cuts = find_thresholds(scored, contamination, scorer.centred, size)
    return Scored(with_levels(scored, cuts).drop("raw_score"), cuts, model)


def staged_features(log: DataFrame, grain: str) -> DataFrame:
    """Keys and model features of a log as a staged table."""
    return stage(features_of(log, grain).select(*KEYS, *FEATURES), "features", WORK_ROWS)


def build_risk_table(
    log: DataFrame, grain: str, scorer: Scorer | None = None, contamination: float = CONTAMINATION
) -> DataFrame:
    """The 20-column risk table of a tagged log."""
    scorer = scorer or ZScore()
    single_pass = isinstance(scorer, ZScore)
    features = features_of(log, grain) if single_pass else staged_features(log, grain)
    return score_features(features, scorer, contamination).frame.select(*EXPORT)
