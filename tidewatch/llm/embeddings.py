"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Vectors at the cosine threshold are sqrt(2 - 2 cos) apart once normalised, so their projections
on a random direction differ by about that length / sqrt(dim). A query's window is centred on
its own projection; a pair that collides in enough of the sorted projections, a number taken
from the binomial tail at a stated recall, is verified in double precision.

Vectors of a label meet in cells: the label is halved at the median of a few further projections,
as often as its size asks, and a vector visits the other half when its window reaches over the
cut. Each vector is at home in one cell, so every ordered pair is judged at most once. A cell
with many vectors, such as a group of copies, is worked on in blocks of bounded size, and a block
returns counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stage
from tidewatch.llm.components import components, least_of_parts

COSINE = 0.98
PROJECTIONS = 24
WIDTH = 2.0  # half a counting window, in deviations of a pair at the threshold
RECALL = 0.99999
CUTS = 16
CUT_WIDTH = 4.0
CELL = 4096
BLOCK = 2048


@lru_cache(maxsize=32)
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` random unit directions as columns."""
    d = np.random.default_rng((seed, dim)).standard_normal((dim, count))
    return d / np.linalg.norm(d, axis=0)


def collisions_needed(projections: int, width: float, recall: float) -> int:
    """The most collisions that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(width / math.sqrt(2))
    tail, needed = 0.0, projections
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        needed = k
        if tail >= recall:
            break
    return needed


def deviation(cosine: float, dim: int) -> float:
    """Of the difference of two projections at the threshold."""
    return math.sqrt(max(2 - 2 * cosine, 0.0) / dim)


PREPARED = "vec_id long, label long, dim int, a long, b long, unit binary, coarse array<double>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; dim is null where a vector cannot link."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        column = batch.column("embedding")
        out: dict = {k: [] for k in ("vec_id", "label", "dim", "a", "b", "unit", "coarse")}
        for i in range(len(ids)):
            raw = column[i].values
            v = None
            if raw is not None and len(raw) and not raw.null_count and labels[i] is not None and ids[i] is not None:
                v = raw.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                top = np.abs(v).max()
                v = v / top if 0 < top < np.inf else None  # also leaves out NaN
                v = None if v is None else v / np.sqrt(v @ v)
            out["vec_id"].append(ids[i])
            out["label"].append(labels[i])
            ok = v is not None
            digest = np.frombuffer(hashlib.blake2b(v.tobytes(), digest_size=16).digest(), np.int64) if ok else (None, None)
            out["dim"].append(len(v) if ok else None)
            out["a"].append(None if not ok else int(digest[0]))
            out["b"].append(None if not ok else int(digest[1]))
            out["unit"].append(v.tobytes() if ok else None)
            out["coarse"].append(v @ directions(len(v), CUTS, 7) if ok else None)
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


_ARROW = pa.schema(
    [
        ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
        ("unit", pa.binary()), ("coarse", pa.list_(pa.float64())),
    ]
)


def _colliding(q: np.ndarray, r: np.ndarray, half: float, needed: int) -> np.ndarray:
    """Boolean (queries, references): enough windows around a query's projections hold the reference."""
    counts = np.zeros((len(q), len(r)), dtype=np.int16)
    rows = np.arange(len(q))
    for j in range(q.shape[1]):
        order = np.argsort(r[:, j], kind="stable")
        line = r[order, j]
        inside = np.zeros((len(q), len(r) + 1), dtype=np.int8)
        inside[rows, np.searchsorted(line, q[:, j] - half, "left")] += 1
        inside[rows, np.searchsorted(line, q[:, j] + half, "right")] -= 1
        counts[:, order] += np.cumsum(inside[:, :-1], axis=1, dtype=np.int8)
    return counts >= needed


def _block(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        unit = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), dim)
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        coarse = np.stack(rows["coarse"].to_numpy())[:, : int(rows["depth"].iloc[0])]
        fine = unit @ directions(dim, PROJECTIONS, 11)
        queries = np.flatnonzero(rows["as_query"].to_numpy())
        refs = np.flatnonzero(rows["as_ref"].to_numpy())
        sigma = deviation(cosine, dim)
        needed = collisions_needed(PROJECTIONS, WIDTH, RECALL)
        links = np.zeros(len(rows), dtype=np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, len(queries), 256):
            q = queries[first : first + 256]
            x, y = np.nonzero(_colliding(fine[q], fine[refs], WIDTH * sigma + 1e-9, needed))
            x, y = q[x], refs[y]
            near = (np.abs(coarse[x] - coarse[y]) <= CUT_WIDTH * sigma + 1e-9).all(axis=1) & (node[x] != node[y])
            x, y = x[near], y[near]
            dot = np.concatenate([np.einsum("ij,ij->i", unit[x[i : i + 65536]], unit[y[i : i + 65536]]) for i in range(0, len(x), 65536)] or [np.empty(0)])
            x, y = x[dot >= cosine], y[dot >= cosine]
            np.add.at(links, x, copies[y])
            # A forest of what is linked so far is enough; it keeps the block's memory bounded.
            a = np.concatenate([x, *(e[0] for e in ends)])
            b = np.concatenate([y, *(e[1] for e in ends)])
            least = least_of_parts(a, b, len(rows))
            moved = np.flatnonzero(least != np.arange(len(rows)))
            ends = [(moved, least[moved])]
        least = np.arange(len(rows))
        for a, b in ends:
            least[a] = b
        out = pd.DataFrame({"node": node, "links": links, "least": node[least]})
        return out[(out["links"] > 0) | (out["node"] != out["least"])]

    return run


def linked_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal, non-null label and equal length are compared. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; so do rows without a
    vec_id, whose component is null. Every row counts as a vector of its own, so repeated rows
    link with each other; rows that share a vec_id share a node. ``component_id`` is the least
    vec_id reachable. At the threshold a pair is found with a probability of about 0.9999, nearer
    pairs more surely; no pair below it is linked. Columns other than the three are not read.
    """
    chosen = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")
    )
    marked = stage(chosen.mapInArrow(_prepare, PREPARED), "vectors")
    able = marked.where("dim is not null")
    same = ["label", "dim", "a", "b"]
    classes = able.groupBy(*same).agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("unit", "coarse")).alias("one")
    )
    classes = stage(classes.select(*same, "node", "copies", "one.unit", "one.coarse"), "vector-classes")

    # Cuts per label: as many halvings as bring a cell to CELL vectors.
    cut = [F.percentile_approx(F.col("coarse")[j], 0.5, 1000) for j in range(CUTS)]
    labels = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"), F.array(*cut).alias("cuts"))
    depth = F.greatest(F.lit(0), F.least(F.lit(CUTS), F.ceil(F.log2(F.col("size") / CELL)).cast("int")))
    labels = labels.select("label", "dim", "cuts", depth.alias("depth"))
    reach = F.sqrt(F.lit(2 - 2 * cosine) / F.col("dim")) * CUT_WIDTH
    placed = classes.join(labels, ["label", "dim"]).withColumn("reach", reach)

    def halves(codes, j):
        apart = F.col("coarse")[j] - F.col("cuts")[j]
        own = F.when(apart >= 0, 1).otherwise(0)
        both = F.abs(apart) <= F.col("reach")
        one = F.transform(codes, lambda c: c * 2 + own)
        two = F.flatten(F.transform(codes, lambda c: F.array(c * 2, c * 2 + 1)))
        return F.when(both, two).otherwise(one)

    steps = F.sequence(F.lit(1), F.col("depth"))
    levels = F.when(F.col("depth") > 0, F.transform(steps, lambda j: j - 1)).otherwise(F.array().cast("array<int>"))
    home = F.aggregate(levels, F.lit(0), lambda c, j: c * 2 + F.when(F.col("coarse")[j] >= F.col("cuts")[j], 1).otherwise(0))
    cells = placed.withColumns({"home": home, "cell": F.explode(F.aggregate(levels, F.array(F.lit(0)), halves))})
    columns = ["label", "dim", "depth", "cell", "node", "copies", "unit", "coarse", (F.col("home") == F.col("cell")).alias("is_home")]
    cells = stage(cells.select(*columns), "cells")

    # Blocks: a query block meets every reference block of its cell.
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = cells.join(sizes, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_query = dealt.select("*", F.col("own").alias("qb"), F.explode(every).alias("rb"), F.lit(True).alias("as_query"))
    as_query = as_query.withColumn("as_ref", F.col("is_home") & (F.col("rb") == F.col("own")))
    as_ref = dealt.where("is_home").select("*", F.explode(every).alias("qb"), F.col("own").alias("rb"), F.lit(False).alias("as_query"))
    as_ref = as_ref.where("qb <> own").withColumn("as_ref", F.lit(True))
    kept = ["label", "dim", "depth", "cell", "qb", "rb", "node", "copies", "unit", "coarse", "as_query", "as_ref"]
    blocks = as_query.select(*kept).unionByName(as_ref.select(*kept)).groupBy("label", "dim", "cell", "qb", "rb")
    found = stage(blocks.applyInPandas(_block(cosine), "node long, links long, least long"), "vector-links")

    joined = stage(components(found.select(F.col("node").alias("a"), F.col("least").alias("b"))), "vector-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select(*same, "node", "copies").join(links, "node", "left").join(joined, "node", "left")
    nodes = nodes.select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("least")
    )
    linked = able.select("vec_id", *same).join(nodes, same).select("vec_id", "n_links", "least")
    alone = marked.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("least"))
    return linked.union(alone).select(
        "vec_id", "n_links", F.col("least").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("least")).alias("kept")
    )
