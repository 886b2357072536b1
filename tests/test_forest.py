from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.clustering import ClusterDistance, reduced
from tidewatch.operators.forest import IsolationForest, average_path, fit_forest
from tidewatch.operators.sampling import tree_samples
from tidewatch.operators.scaling import FeatureScaler
from tidewatch.plans import scoring, tuning
from tidewatch.schema import FEATURES
from tidewatch.staging import stage

ROWS = 500


@pytest.fixture(scope="module")
def features(spark):
    """500 ordinary rows and one far from all of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(ROWS + 1, len(FEATURES)))
    x[:, FEATURES.index("hour")] = rng.integers(0, 24, ROWS + 1)
    x[:, FEATURES.index("is_off_hours")] = 0.0
    x[-1] = 40.0
    rows = [(f"u{i % 7}" if i < ROWS else "odd", i, *map(float, v)) for i, v in enumerate(x)]
    schema = "user STRING, n INT, " + ", ".join(f"{c} DOUBLE" for c in FEATURES)
    df = spark.createDataFrame(rows, schema)
    dated = df.withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), "n"))
    return stage(dated.drop("n"), "test-features")


def _matrix(features):
    rows = features.orderBy("date").collect()
    return np.array([[float(r[c]) for c in FEATURES] for r in rows])


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2447, abs=1e-3)


def test_every_tree_gets_its_rows(features):
    keys = features.select("user", "date")
    own = tree_samples(keys, ROWS + 1, 20, 64, 42).groupBy("tree_id").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("d")
    )
    assert sorted(map(tuple, own.collect())) == [(t, 64, 64) for t in range(20)]
    # The same scheme on both sides of trees * size rows, and in any partitioning.
    few = tree_samples(keys, ROWS + 1, 10, 40, 42)
    assert sorted(r["count"] for r in few.groupBy("tree_id").count().collect()) == [40] * 10
    assert few.exceptAll(tree_samples(keys.repartition(7), ROWS + 1, 10, 40, 42)).isEmpty()
    assert few.select("date").distinct().count() < 400
    small = own_rows = tree_samples(keys, ROWS + 1, 10, 40, 42).where("tree_id = 3").select("date")
    assert small.exceptAll(tree_samples(keys, ROWS + 1, 30, 40, 42).where("tree_id = 3").select("date")).isEmpty() and own_rows.count() == 40
    again = tree_samples(keys, ROWS + 1, 10, 400, 42, bootstrap=True).groupBy("tree_id").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("d")
    )
    assert all(r.n == 400 and 220 < r.d < 340 for r in again.collect())


def test_sample_size_is_an_argument(features):
    small = fit_forest(features, trees=4, max_samples=16, bootstrap=True)
    assert small.sample_size == 16 and small.trees[1.0][0].shape == (4, 15)
    assert fit_forest(features, trees=2, max_samples=10_000).sample_size == ROWS + 1


def _walk(x, feature, cut, path):
    """Depth of one row by following the tree node by node."""
    node = 0
    while node < len(feature):
        node = 2 * node + 1 + int(x[feature[node]] > cut[node])
    return path[node - len(feature)]


def test_scores_follow_the_trees(features):
    forest = fit_forest(features, trees=15)
    x = np.rint(_matrix(features) * 1e9) / 1e9
    got = [r.raw_score for r in forest.transform(features).orderBy("date").collect()]
    trees = list(zip(*forest.trees[1.0], strict=True))
    depths = np.array([[_walk(row, *tree) for tree in trees] for row in x])
    assert got == pytest.approx((2 ** (-depths.mean(axis=1) / average_path(256))).tolist())


def test_trees_split_at_random_down_to_single_rows(features):
    """Path lengths of the sample itself: the leaf holding n rows adds c(n) to its depth."""
    forest = fit_forest(features, shares=(0.5,), trees=5)
    x = np.rint(_matrix(features) * 1e9) / 1e9
    for feature, cut, _ in zip(*forest.trees[0.5], strict=True):
        used = np.unique(feature[np.isfinite(cut)])
        assert len(used) <= 8
        assert FEATURES.index("is_off_hours") not in used
        for f, c in zip(feature, cut, strict=True):
            assert not np.isfinite(c) or x[:, f].min() <= c < x[:, f].max()


def _plain_forest(x, trees, size, rng):
    """A small independent isolation forest: recursive, one row set per node."""
    limit = int(np.ceil(np.log2(size)))

    def grow(rows, depth):
        varying = [c for c in range(x.shape[1]) if np.ptp(x[rows, c]) > 0]
        if depth == limit or len(rows) < 2 or not varying:
            return depth + average_path(len(rows))
        c = rng.choice(varying)
        cut = rng.uniform(x[rows, c].min(), x[rows, c].max())
        left = x[rows, c] <= cut
        return c, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

    def depth_of(row, tree):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    grown = [grow(rng.choice(len(x), size, replace=False), 0) for _ in range(trees)]
    mean = np.array([np.mean([depth_of(row, t) for t in grown]) for row in x])
    return 2 ** (-mean / average_path(size))


def test_agrees_with_an_independent_forest(features):
    got = np.array([r.raw_score for r in fit_forest(features).transform(features).orderBy("date").collect()])
    other = _plain_forest(_matrix(features), 200, 256, np.random.default_rng(1))
    assert ((got > 0) & (got < 1)).all()
    assert got.argmax() == ROWS and other.argmax() == ROWS
    ranks = [np.argsort(np.argsort(s)) for s in (got, other)]
    assert np.corrcoef(*ranks)[0, 1] > 0.9
    assert got.mean() == pytest.approx(other.mean(), abs=0.02)


def test_risk_of_the_forest(features):
    scored = scoring.score_features(features, IsolationForest(trees=50), contamination=0.02)
    rows = scored.frame.collect()
    flagged = [r for r in rows if r.anomaly == -1]
    assert len(flagged) == 10 and all(r.risk_score > 0 for r in flagged)
    assert all(r.anomaly_score == -r.risk_score for r in rows)
    assert max(rows, key=lambda r: r.risk_score).user == "odd"
    levels = [r.risk_level for r in rows]
    # 501 rows: positions 475 and 375 are whole, and the boundary rows go up.
    assert levels.count("Low") <= 375 and levels.count("High") >= 26
    again = scoring.score_features(features.repartition(5), IsolationForest(trees=50), contamination=0.02)
    assert sorted(map(tuple, again.frame.collect())) == sorted(map(tuple, rows))


def test_forest_of_nothing(features):
    none = features.where("user = 'nobody'")
    assert scoring.score_features(none, IsolationForest()).frame.isEmpty()


def test_scaler(features):
    got = FeatureScaler.fit(features).transform(features).orderBy("date").toPandas()[list(FEATURES)].to_numpy()
    x = _matrix(features)
    std = x.std(axis=0)
    constant = std == 0
    expected = (x - x.mean(axis=0)) / np.where(constant, 1, std)
    np.testing.assert_allclose(got, expected, atol=1e-9)


def test_cluster_distance(features):
    model = ClusterDistance(k=3, rounds=5).fit(features)
    got = [r.raw_score for r in model.transform(features).orderBy("date").collect()]
    x = _matrix(features)
    scaled = (x - np.array(model.scaler.means)) / np.array(model.scaler.stds)
    centres = np.array(model.centres)
    expected = np.sqrt(((scaled[:, None, :] - centres) ** 2).sum(axis=2)).min(axis=1)
    assert got == pytest.approx(expected.tolist(), abs=1e-5)
    # Another partitioning and another order give the same centres.
    assert ClusterDistance(k=3, rounds=5).fit(features.repartition(5).orderBy(F.desc("date"))).centres == model.centres
    assert ClusterDistance(k=3).fit(features.limit(0)).centres == ()


@pytest.fixture(scope="module")
def lopsided(spark):
    """3,000 rows in one place and seven groups of six far from it and from each other."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3042, len(FEATURES)))
    for g in range(7):
        x[3000 + 6 * g : 3006 + 6 * g] += 40 * rng.normal(size=len(FEATURES))
    rows = [(f"u{i}", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "user STRING, " + ", ".join(f"{c} DOUBLE" for c in FEATURES))
    return stage(df.withColumn("date", F.lit("2024-01-01").cast("timestamp_ntz")), "lopsided").orderBy("user")


def _cost(x, centres):
    return ((x[:, None, :] - np.array(centres)) ** 2).sum(axis=2).min(axis=1).sum()


def test_seeds_find_small_far_groups(lopsided):
    model = ClusterDistance().fit(lopsided)
    rows = lopsided.toPandas()
    scaled = (rows[list(FEATURES)].to_numpy() - np.array(model.scaler.means)) / np.array(model.scaler.stds)
    marks = [hashlib.md5(f"{u}|2024-01-01 00:00:00".encode()).hexdigest() for u in rows["user"]]
    centres = scaled[np.argsort(marks)[:8]]  # eight rows at random, and then the same rounds
    for _ in range(10):
        near = ((scaled[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([scaled[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
    assert _cost(scaled, model.centres) < 0.5 * _cost(scaled, centres)
    assert ClusterDistance().fit(lopsided.repartition(7)).centres == model.centres


def test_reduction_of_weighted_seeds():
    at = [(0.0, 0.0), (0.1, 0.0), (9.0, 0.0), (0.0, 5.0), (9.0, 0.1)]
    assert reduced(at, [10, 3, 1, 2, 1], 3) == [0, 4, 3]
    assert reduced(at, [1, 1, 1, 1, 1], 9) == [0, 4, 3, 1, 2] and reduced(at[:1], [4], 3) == [0]
    assert reduced([(1.0,), (1.0,), (1.0,)], [2, 5, 5], 2) == [1, 0]


def test_grid(spark, features):
    grid = tuning.run_grid(features, (0.02, 0.1), (0.5, 1.0), trees=30)
    columns = grid.forest.score_columns()
    scores = grid.scores.toPandas()
    rows = {(r.contamination, r.max_features): r for r in grid.summary.collect()}
    assert sorted(rows) == [(0.02, 0.5), (0.02, 1.0), (0.1, 0.5), (0.1, 1.0)]
    for (contamination, share), row in rows.items():
        risk = scores[columns[share]] - np.quantile(scores[columns[share]], 1 - contamination)
        assert row.score_std == pytest.approx(np.std(risk))
        assert row.score_mean == pytest.approx(np.mean(risk))
        assert row.anomaly_count == (risk > 1e-15).sum()
        assert row.high_risk_count == (risk >= risk.quantile(0.95)).sum()
        assert row.medium_risk_count == ((risk >= risk.quantile(0.75)) & (risk < risk.quantile(0.95))).sum()
    (best,) = tuning.best_config(grid.summary).collect()
    assert best.score_std == max(r.score_std for r in rows.values()) and best.contamination == 0.02
    pivot = tuning.grid_pivot(grid.summary, "anomaly_count", (0.5, 1.0)).collect()
    assert [tuple(r) for r in pivot] == [
        (c, rows[c, 0.5].anomaly_count, rows[c, 1.0].anomaly_count) for c in (0.02, 0.1)
    ]
    tuned = tuning.tuned_scores(grid)
    assert set(FEATURES) < set(tuned.frame.columns) and "raw_score" not in tuned.frame.columns
    assert tuned.frame.where("anomaly = -1").count() == best.anomaly_count
    alone = fit_forest(features, (best.max_features,), trees=30).transform(features)
    joined = alone.select("date", "raw_score").join(tuned.frame.select("date", "risk_score"), "date")
    spread = joined.select(F.stddev(F.col("raw_score") - F.col("risk_score"))).first()[0]
    assert spread == pytest.approx(0, abs=1e-12)
