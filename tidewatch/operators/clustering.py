"""Clustering scorer: distance to the nearest k-means centre."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from ..staging import stage
from .scaling import FeatureScaler
from .scorers import SCORE_DIGITS

# Rows of a staged file of scaled rows.
WORK_ROWS = 20_000
# Places kept of a centre in every round, so that the order of a sum moves no row.
CENTRE_DIGITS = 6


def _nearest(scaled: list[Column], centres: tuple[tuple[float, ...], ...]) -> Column:
    """Squared distance ``d`` to the nearest centre and its number ``c``, the first of equals: each
    distance is worked out once."""
    gaps = [reduce(add, [(x - F.lit(m)) * (x - F.lit(m)) for x, m in zip(scaled, c, strict=True)]) for c in centres]
    ends = [F.struct(gap.alias("d"), F.lit(i).alias("c")) for i, gap in enumerate(gaps)]
    return F.least(*ends) if len(ends) > 1 else ends[0]


@dataclass(frozen=True)
class ClusterModel:
    scaler: FeatureScaler
    centres: tuple[tuple[float, ...], ...]

    def transform(self, features: DataFrame) -> DataFrame:
        scaled = features.select("*", F.struct(*self.scaler.columns()).alias("_scaled"))
        columns = [F.col(f"_scaled.{n}") for n in self.scaler.names]
        distance = F.sqrt(_nearest(columns, self.centres)["d"]) if self.centres else F.lit(0.0)
        return scaled.withColumn("raw_score", F.round(distance, SCORE_DIGITS)).drop("_scaled")


def _gaps(vectors: list[tuple[float, ...]]):
    """A UDF from a row to its squared distance ``d`` to the nearest of ``vectors`` and that one's number ``c``."""
    table = np.array(vectors)

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        x = rows.to_numpy(dtype=float)
        best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int32)
        for i, v in enumerate(table):
            gap = ((x - v) ** 2).sum(axis=1)
            nearer = gap < best
            best[nearer], at[nearer] = gap[nearer], i
        return pd.DataFrame({"d": best, "c": at})

    # Spark infers the kind of UDF from these hints.
    nearest.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(nearest, "d DOUBLE, c INT")


def reduced(vectors: list[tuple[float, ...]], weights: list[int], k: int) -> list[int]:
    """``k`` of the weighted vectors: the heaviest, then again and again the one whose weight times squared
    distance to those chosen is greatest, the first of equals."""
    x, w = np.array(vectors), np.array(weights, dtype=float)
    chosen: list[int] = []
    gap = np.full(len(x), 1.0)
    while len(chosen) < min(k, len(x)):
        worth = np.round(w * gap, CENTRE_DIGITS)
        worth[chosen] = -1.0
        chosen.append(int(worth.argmax()))
        far = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        gap = far if len(chosen) == 1 else np.minimum(gap, far)
    return chosen


@dataclass(frozen=True)
class ClusterDistance:
    """Fit k-means on the scaled vector. ``features`` should be a staged table.

    Seeding is k-means|| (Bahmani et al., 2012): from the row of least md5 of user and date, each of
    ``seed_rounds`` rounds draws some ``2 * k`` rows, likelier the farther they are from those drawn
    before, with chances from the md5 of row and round. The drawn rows, weighted by the rows nearest to
    them, are reduced to ``k``. Then come up to ``rounds`` of assigning every row to its nearest centre
    (the first of equals) and averaging, one aggregation each, until the centres rest. A centre without
    rows stays. Nothing depends on the partitioning. The scaled rows are staged once, in files of bounded
    rows, as a round is work and not bytes; some ``2 * k * seed_rounds`` rows reach the driver.
    """

    k: int = 8
    rounds: int = 10
    centred: bool = False
    seed_rounds: int = 4

    def fit(self, features: DataFrame) -> ClusterModel:
        scaler = FeatureScaler.fit(features, FEATURES)
        names = list(scaler.names)
        moment = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
        key = F.md5(F.concat_ws("|", F.col("user").cast("string"), moment).cast("binary"))
        scaled = stage(features.select(*scaler.columns(), key.alias("_key")), "scaled", WORK_ROWS)
        centres = self._seeds(scaled, names)
        if not centres:
            return ClusterModel(scaler, ())
        for _ in range(self.rounds):
            nearest = scaled.select(*names, _nearest([F.col(n) for n in names], centres)["c"].alias("_c"))
            means = nearest.groupBy("_c").agg(*(F.round(F.avg(n), CENTRE_DIGITS).alias(n) for n in names)).collect()
            moved = {r["_c"]: tuple(r[n] for n in names) for r in means}
            before, centres = centres, tuple(moved.get(i, c) for i, c in enumerate(centres))
            if centres == before:
                break
        return ClusterModel(scaler, centres)

    def _seeds(self, scaled: DataFrame, names: list[str]) -> tuple[tuple[float, ...], ...]:
        vector = lambda r: tuple(round(r[n], CENTRE_DIGITS) for n in names)
        drawn = [vector(r) for r in scaled.orderBy("_key", *names).limit(1).collect()]
        if not drawn:
            return ()
        row = F.struct(*names)
        for turn in range(self.seed_rounds):
            far = scaled.select("*", _gaps(drawn)(row)["d"].alias("_far"))
            total, most = far.agg(F.sum("_far"), F.max("_far")).first()
            if not total:
                break
            digits = F.substring(F.md5(F.concat_ws("|", "_key", F.lit(turn)).cast("binary")), 1, 8)
            chance = F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)
            drawn_at = lambda far: chance < far * F.lit(2.0 * self.k) / F.lit(total)  # noqa: B023, E731
            # Few rows have a chance that even the farthest would be drawn at; only they are measured again.
            near_draw = scaled.where(drawn_at(F.lit(most))).select("*", _gaps(drawn)(row)["d"].alias("_far"))
            hits = near_draw.where(drawn_at(F.col("_far"))).collect()
            drawn += [vector(r) for r in sorted(hits, key=lambda r: (r["_key"], vector(r)))]
        held = scaled.select(_gaps(drawn)(row)["c"].alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
        weights = dict(tuple(r) for r in held)
        return tuple(drawn[i] for i in reduced(drawn, [weights.get(i, 0) for i in range(len(drawn))], self.k))
