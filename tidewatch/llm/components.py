"""Connected components of an edge table by alternating star contractions.

Large-star points every larger neighbour of a node at its smallest neighbour; small-star points
the smaller ones there. Both are a grouped minimum (with map-side combine) and a join, so a hub
with many neighbours is neither gathered nor sorted in one task. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.llm.common import brief_shuffles, stage_path

MAX_ROUNDS = 60


def _written(df: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, and a digest that changes when they do."""
    seen = Observation()
    spark, path = df.sparkSession, stage_path(df.sparkSession, "edges")
    digest = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    with brief_shuffles(spark):
        df.observe(seen, *digest).write.parquet(path)
    return spark.read.schema("a long, b long").parquet(path), (seen.get["n"], seen.get["h"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (node, target) with target < node, after one star step; ``edges`` have a > b."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    ``edges`` holds longs ``a`` and ``b`` in any order; loops, repeats and rows with a null are
    without effect. An empty table gives an empty result.
    """
    both = edges.where("a is not null and b is not null")
    pairs = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    current, mark = _written(pairs.distinct())
    if mark[0] == 0:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    for _ in range(MAX_ROUNDS):
        after, next_mark = _written(_star(_star(current, large=True), large=False))
        current, changed, mark = after, next_mark != mark, next_mark
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    tops = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def least_of_parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For positions 0..n-1 in memory, the least position reachable by the links a-b."""
    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, a, label[b])
        np.minimum.at(after, b, label[a])
        after = after[after]
        if (after == label).all():
            return label
        label = after
