"""Forest tuning over contamination and max_features.

Contamination only moves the decision offset, so one forest per ``max_features``
value is grown; every grid point then follows from quantiles of its scores.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.forest import Forest, fit_forest
from ..operators.quantiles import exact_quantiles
from ..schema import (
    CONTAMINATION,
    FEATURES,
    GRID_CONTAMINATION,
    GRID_MAX_FEATURES,
    HIGH_QUANTILE,
    KEYS,
    MEDIUM_QUANTILE,
    SEED,
    TREES,
)
from ..staging import stage
from .scoring import Scored, Thresholds, with_levels


@dataclass(frozen=True)
class Grid:
    """Staged scores of every forest, nothing else, and the summary of every grid point."""

    features: DataFrame
    scores: DataFrame
    summary: DataFrame
    forest: Forest
    cuts: dict[tuple[float, float], Thresholds]


def run_grid(
    features: DataFrame,
    contaminations: tuple[float, ...] = GRID_CONTAMINATION,
    shares: tuple[float, ...] = GRID_MAX_FEATURES,
    trees: int = TREES,
    seed: int = SEED,
) -> Grid:
    """Fit, score once for all forests, and summarise in one aggregation."""
    forest = fit_forest(features, shares, trees, seed)
    columns = forest.score_columns()
    scores = stage(forest.score_all(features).select(*columns.values()), "grid")
    probs = [*(1.0 - c for c in contaminations), MEDIUM_QUANTILE, HIGH_QUANTILE]
    quantiles = exact_quantiles(scores, list(columns.values()), probs)
    cuts = {}
    for share, column in columns.items():
        *offsets, medium, high = (q if q is not None else 0.0 for q in quantiles[column])
        for c, offset in zip(contaminations, offsets, strict=True):
            cuts[c, share] = Thresholds(offset, medium, high, offset)
    return Grid(features, scores, _summary(scores, columns, cuts), forest, cuts)


def _summary(scores: DataFrame, columns: dict[float, str], cuts: dict) -> DataFrame:
    points = [_point(F.col(columns[share]), c, share, cut) for (c, share), cut in sorted(cuts.items())]
    return scores.agg(F.array(*points).alias("points")).select(F.inline("points"))


def _point(score: Column, contamination: float, share: float, cut: Thresholds) -> Column:
    """One grid point over the raw scores; the spread does not depend on the offset."""
    return F.struct(
        F.lit(contamination).alias("contamination"),
        F.lit(share).alias("max_features"),
        F.stddev_pop(score).alias("score_std"),
        (F.avg(score) - F.lit(cut.offset)).alias("score_mean"),
        F.count_if(score > F.lit(cut.anomaly)).alias("anomaly_count"),
        F.count_if(score >= F.lit(cut.high)).alias("high_risk_count"),
        F.count_if((score >= F.lit(cut.medium)) & (score < F.lit(cut.high))).alias("medium_risk_count"),
    )


def best_config(summary: DataFrame) -> DataFrame:
    """The grid point with the widest spread; a tie goes to the smallest settings."""
    # Rounded, so that the last bits of a sum decide nothing.
    return summary.orderBy(F.desc(F.round("score_std", 9)), "contamination", "max_features").limit(1)


def grid_pivot(summary: DataFrame, value: str, shares: tuple[float, ...] = GRID_MAX_FEATURES) -> DataFrame:
    """Contamination by max_features table of one summary column."""
    pivoted = summary.groupBy("contamination").pivot("max_features", list(shares)).agg(F.first(value))
    names = [f"max_features_{round(share * 100):03d}" for share in shares]
    return pivoted.toDF("contamination", *names).orderBy("contamination")


def tuned_scores(grid: Grid) -> Scored:
    """Risk table of the best grid point: its forest, already grown, scores the features once more."""
    best = best_config(grid.summary).first()
    share = best["max_features"] if best else GRID_MAX_FEATURES[-1]
    contamination = best["contamination"] if best else CONTAMINATION
    cuts = grid.cuts[contamination, share]
    chosen = replace(grid.forest, trees={share: grid.forest.trees[share]})
    frame = with_levels(chosen.transform(grid.features), cuts)
    return Scored(frame.drop("raw_score"), cuts, chosen)
