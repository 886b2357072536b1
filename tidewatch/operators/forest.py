"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Fitting draws a bounded sample per tree and grows all trees together, level by level, as
grouped minima and maxima. Every choice (rows of a tree, its columns, splits and cuts) follows from
the MD5 of what it is for, so a forest depends on data and seed alone and SQL can repeat it. A forest is a
few thousand numbers whatever the size of the data, so it is broadcast, and scoring is one
vectorised pass over the feature table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES, SAMPLE_SIZE, SEED, TREES
from .sampling import tree_samples
from .scaling import steady_vector

EULER_GAMMA = 0.5772156649015329
ROWS_PER_BLOCK = 5_000


# Path lengths are multiples of this, so that their sums are exact in any order.
PATH_UNIT = 2.0**-20


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points, to the nearest PATH_UNIT."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return round((2.0 * (log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n) / PATH_UNIT) * PATH_UNIT


def chosen_columns(share: float, tree: int, seed: int, width: int) -> list[bool]:
    """Which of ``width`` columns a tree may split: a share of them, those of least MD5."""
    marks = [hashlib.md5(f"{seed}|{share_key(share)}|{tree}|c{i}".encode()).hexdigest() for i in range(width)]
    kept = sorted(range(width), key=marks.__getitem__)[: max(1, int(share * width))]
    return [i in kept for i in range(width)]


def share_key(share: float) -> int:
    """A ``max_features`` share as it enters a hash."""
    return round(share * 1000)


def _split_level(width: int, level: int, seed: int) -> str:
    """SQL that splits every node of a level of ``rows`` at a random cut of a random column that varies in it.

    A node is a window over its rows, and a tree lies in one partition, so no level shuffles.
    """
    node = "OVER (PARTITION BY share, tree_id, node)"
    low, high = (", ".join(f"{f}(x[{i}]) {node}" for i in range(width)) for f in ("min", "max"))
    unit = "cast(conv(substring(digest, {}, 8), 16, 10) AS double) / 4294967296D".format
    kept = "share, tree_id, x, node, splits, stopped"
    return f"""
      SELECT share, tree_id, x, 2 * node + 1 + if(coalesce(get(x, col) > cut, false), 1, 0) AS node,
        if(col IS NULL, splits, concat(splits, array(struct(node AS node, col AS feature, cut AS cut)))) AS splits,
        coalesce(stopped, if(col IS NULL, {level}, NULL)) AS stopped
      FROM (SELECT {kept}, col, if(least + share_of * (most - least) < most, least + share_of * (most - least), least) AS cut
      FROM (SELECT {kept}, col, share_of, get(low, col) AS least, get(high, col) AS most
      FROM (SELECT {kept}, low, high, {unit(9)} AS share_of, get(varying, cast(floor({unit(1)} * size(varying)) AS int)) AS col
      FROM (SELECT *, filter(sequence(0, {width - 1}), i -> high[i] > low[i]) AS varying,
        md5(cast(concat_ws('|', {seed}, share, tree_id, node) AS binary)) AS digest
      FROM (SELECT {kept}, array({low}) AS low, array({high}) AS high FROM {{rows}})))))"""


def grown_nodes(samples: DataFrame, shares: tuple[float, ...], trees: int, names: tuple[str, ...], depth: int, seed: int) -> DataFrame:
    """(share, tree_id, node, feature, cut, stopped, n) of all splits and, on the last level, all leaves.

    A tree is a complete binary layout: node i has children 2i+1 and 2i+2, and a node that does not
    split sends every row left. ``stopped`` is the level at which a leaf's rows ceased to be split.
    """
    spark = samples.sparkSession
    settings = [(share_key(s), t, chosen_columns(s, t, seed, len(names))) for s in shares for t in range(trees)]
    chosen = spark.createDataFrame(settings, "share int, tree_id int, chosen array<boolean>")
    # A column that a tree does not use is constant there and never splits.
    held = F.array(*(F.when(F.get("chosen", F.lit(i)), F.col(c)).otherwise(0.0) for i, c in enumerate(names)))
    none = F.array().cast("array<struct<node:int,feature:int,cut:double>>")
    # A stated number of partitions: the samples are small in bytes, but splitting them is work, and
    # AQE would otherwise merge them all into one task.
    tasks = max(1, min(len(settings), spark.sparkContext.defaultParallelism))
    rows = samples.select(F.col("tree_id").cast("int").alias("tree_id"), *names).join(chosen, "tree_id")
    rows = rows.select("share", "tree_id", held.alias("x")).repartition(tasks, "share", "tree_id")
    rows = rows.select("*", F.lit(0).alias("node"), none.alias("splits"), F.lit(None).cast("int").alias("stopped"))
    for level in range(depth):
        rows = spark.sql(_split_level(len(names), level, seed), rows=rows)
    leaf = F.struct("node", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("cut"))
    seen = rows.select("share", "tree_id", F.coalesce("stopped", F.lit(depth)).alias("stopped"), F.explode(F.concat("splits", F.array(leaf))).alias("at"))
    return seen.groupBy("share", "tree_id", F.col("at.node").alias("node")).agg(
        F.any_value("at.feature").alias("feature"), F.any_value("at.cut").alias("cut"),
        F.any_value("stopped").alias("stopped"), F.count(F.lit(1)).alias("n"),
    )


def _arrays(nodes: pd.DataFrame, trees: int, depth: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest's splits and leaf path lengths as one array each, a row per tree."""
    inner, slots = 2**depth - 1, 2**depth
    feature, cut = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    path = np.full((trees, slots), float(depth))
    leaf = nodes["node"].to_numpy() >= inner
    split, ends = nodes[~leaf], nodes[leaf]
    feature[split["tree_id"], split["node"]] = split["feature"].astype(np.int64)
    cut[split["tree_id"], split["node"]] = split["cut"]
    mean_path = np.array([average_path(n) for n in range(size + 1)])
    path[ends["tree_id"], ends["node"] - inner] = ends["stopped"] + mean_path[ends["n"].to_numpy()]
    return feature, cut, path


@dataclass(frozen=True)
class Forest:
    """Grown trees of one or more ``max_features`` settings, as arrays by tree."""

    names: tuple[str, ...]
    rows: int
    sample_size: int
    trees: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def settings(self) -> tuple[float, ...]:
        return tuple(sorted(self.trees))

    def score_columns(self) -> dict[float, str]:
        return {share: f"score_{round(share * 100):03d}" for share in self.settings}

    def score_all(self, features: DataFrame) -> DataFrame:
        """Add one score column per setting, all from one pass over the rows."""
        columns = self.score_columns()
        score = _scorer(features, self, columns)
        scored = features.withColumn("_scores", score(F.struct(*steady_vector(self.names))))
        return scored.withColumns({c: F.col(f"_scores.{c}") for c in columns.values()}).drop("_scores")

    def transform(self, features: DataFrame) -> DataFrame:
        """Add ``raw_score`` of a forest with a single setting."""
        (column,) = self.score_columns().values()
        return self.score_all(features).withColumnRenamed(column, "raw_score")


def _scorer(features: DataFrame, forest: Forest, columns: dict[float, str]):
    grown = {columns[share]: trees for share, trees in forest.trees.items()}
    shared = features.sparkSession.sparkContext.broadcast(grown)
    normal = average_path(forest.sample_size) or 1.0
    block_rows, names = ROWS_PER_BLOCK, list(columns.values())

    def depths(x, trees):
        """Summed path length of each row, tree by tree over blocks that stay in cache."""
        import numpy as np

        total = np.zeros(len(x))
        inner = trees[0].shape[1]
        levels = (inner + 1).bit_length() - 1
        for start in range(0, len(x), block_rows):
            block = np.ascontiguousarray(x[start : start + block_rows])
            size, width = block.shape
            flat, base = block.ravel(), np.arange(size) * width
            node, index = np.empty(size, np.intp), np.empty(size, np.intp)
            value, limit, above = np.empty(size), np.empty(size), np.empty(size, bool)
            for feature, cut, path in zip(*trees, strict=True):
                node.fill(0)
                for _ in range(levels):
                    feature.take(node, out=index, mode="clip")
                    index += base
                    flat.take(index, out=value, mode="clip")
                    cut.take(node, out=limit, mode="clip")
                    np.greater(value, limit, out=above)
                    node += node
                    node += 1
                    node += above
                node -= inner
                path.take(node, out=value, mode="clip")
                total[start : start + size] += value
        return total

    # Spark infers the kind of UDF from these hints.
    def score(vectors: pd.DataFrame) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        x = vectors.to_numpy(dtype=float)
        result = {}
        for name, trees in shared.value.items():
            mean = depths(x, trees) / len(trees[0])
            result[name] = np.exp2(-mean / normal)
        return pd.DataFrame(result, columns=names)

    score.__annotations__ = {"vectors": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(score, ", ".join(f"{c} DOUBLE" for c in names))


def fit_forest(
    features: DataFrame,
    shares: tuple[float, ...] = (1.0,),
    trees: int = TREES,
    seed: int = SEED,
    names: tuple[str, ...] = FEATURES,
    max_samples: int = SAMPLE_SIZE,
    bootstrap: bool = False,
) -> Forest:
    """Grow ``trees`` trees for every ``max_features`` share on the same row samples.

    A tree sees ``max_samples`` rows, or all of a smaller table, with replacement if ``bootstrap``.
    ``features`` is read twice (a count and the sample pass) and should be staged.
    """
    rows = features.count()
    size = min(max_samples, rows)
    if not size:
        return Forest(names, 0, 0, {share: _empty_forest() for share in shares})
    depth = max(1, ceil(log2(max(size, 2))))
    vectors = features.select("user", "date", *steady_vector(names))
    samples = tree_samples(vectors, rows, trees, size, seed, bootstrap)
    # Bounded by trees * 2^(depth + 1) rows per setting, independent of the data.
    table = grown_nodes(samples, shares, trees, names, depth, seed).toPandas()
    stacked = {float(share): _arrays(table[table["share"] == share_key(share)], trees, depth, size) for share in shares}
    return Forest(names, rows, size, stacked)


def _empty_forest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros((1, 1), dtype=np.int64), np.full((1, 1), np.inf), np.zeros((1, 2))


@dataclass(frozen=True)
class IsolationForest:
    """Scorer with one ``max_features`` setting; risk 0 is the contamination cut."""

    max_features: float = 1.0
    trees: int = TREES
    seed: int = SEED
    centred: bool = True
    max_samples: int = SAMPLE_SIZE
    bootstrap: bool = False

    def fit(self, features: DataFrame) -> Forest:
        return fit_forest(
            features, (self.max_features,), self.trees, self.seed, max_samples=self.max_samples, bootstrap=self.bootstrap
        )

