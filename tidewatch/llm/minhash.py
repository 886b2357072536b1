"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations make the whole signature: the first scatters the shingles over a circular
universe, the second gives ranks, and coordinate k is the least rank after shifting the second
by k places. A document's K ranks at a shingle are therefore one contiguous slice.

The plan never holds a group of copies together and never lists all pairs of one:

1. Texts with equal shingle sets collapse to a class; the rest works on classes.
2. Classes that share a band key form a bucket. The most connected class of a bucket is its hub,
   and the bucket's classes are compared with the hub only (exact Jaccard on full sets).
3. The buckets of a hub are its family. Where verified links leave a family in several parts, the
   classes outside its main part are compared with all others, in blocks of bounded size that hold
   full sets and return a spanning forest of the links found, never pairs.

So two classes of a bucket stay uncompared only if verified links connect them already.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, stage
from tidewatch.llm.components import components, least_of_parts
from tidewatch.llm.hashing import mix, shingle_set, texts_words

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 4
SHINGLE = 5
PERCENT = 75
# Bounds of a block: classes, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000


@lru_cache(maxsize=2)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all slices of ``coordinates`` ranks of the circular second."""
    rng = np.random.default_rng(1729)
    scatter = rng.permutation(UNIVERSE).astype(np.int32)
    ranks = rng.permutation(UNIVERSE).astype(np.int32)
    circle = np.concatenate([ranks, ranks[: coordinates - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(circle, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Least rank per coordinate over a non-empty set of 64-bit shingle hashes."""
    scatter, circle = _permutations(coordinates)
    at = scatter[(shingles >> np.uint64(44)).astype(np.int64) % UNIVERSE]
    least = np.full(coordinates, UNIVERSE, dtype=np.int32)
    for first in range(0, len(at), 4096):
        np.minimum(least, circle[at[first : first + 4096]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band of equally many coordinates."""
    rows = sig.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    words, cuts = texts_words(texts)
    return [shingle_set(words[cuts[i] : cuts[i + 1]], size) for i in range(len(texts))]


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands): set size, a 128-bit digest of the set, the band keys."""

    def work(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n": [], "set_a": [], "set_b": [], "bands": []}
        for shingles in _sets(batch.column("text").to_pylist(), size):
            digest = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)
            out["n"].append(len(shingles))
            out["set_a"].append(int(digest[0]))
            out["set_b"].append(int(digest[1]))
            out["bands"].append(band_keys(signature(shingles, bands * rows), bands) if len(shingles) else [])
        return out

    schema = "doc_id long, n long, set_a long, set_b long, bands array<long>"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), "text", schema, work)


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles): the full set as sorted hashes."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = [s.view(np.int64) for s in _sets(batch.column("text").to_pylist(), size)]
        return {"doc_id": batch.column("doc_id"), "shingles": sets}

    return arrow_map(docs, "text", "doc_id long, shingles array<long>", work)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    The shuffle carries each set once for either end and once per pair; a hub's many pairs are
    on the side that AQE splits.
    """
    ends = [sets.select(F.col("doc_id").alias(e), F.col("shingles").alias(f"{e}_set")) for e in "ab"]
    joined = pairs.join(ends[1], "b").join(ends[0], "a")
    shared = F.size(F.array_intersect("a_set", "b_set")).alias("shared")
    sizes = (F.size("a_set") + F.size("b_set")).alias("sizes")
    return joined.select("a", "b", shared, sizes).where(f"100 * shared >= {percent} * (sizes - shared)").select("a", "b")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def shared_counts(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every row set with every column set, by products of incidence matrices."""
    both = rows + columns
    sizes = [len(x) for x in both]
    values, slot, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    often = seen[slot] > 1  # what only one set has is shared by none
    slot, owner = np.cumsum(seen > 1)[slot[often]] - 1, owner[often]
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    counts = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = 4096
    for first in range(0, int(slot[-1]) + 1 if len(slot) else 0, width):
        a, b = np.searchsorted(slot, [first, first + width])
        held = np.zeros((len(both), width), dtype=np.float32)
        held[owner[a:b], slot[a:b] - first] = 1
        counts += held[: len(rows)] @ held[len(rows) :].T
    return counts.astype(np.int64)


def _block_links(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node", kind="stable")
        near, far = block[block["first"]], block[~block["first"]]
        far = near if not len(far) else far
        sizes = [b["shingles"].map(len).to_numpy(np.int64) for b in (near, far)]
        shared = shared_counts(list(near["shingles"]), list(far["shingles"]))
        linked = 100 * shared >= percent * (sizes[0][:, None] + sizes[1] - shared)
        linked &= near["part"].to_numpy()[:, None] != far["part"].to_numpy()
        x, y = np.nonzero(linked)
        nodes = np.unique(np.concatenate([near["node"], far["node"]]))
        a, b = np.searchsorted(nodes, near["node"].to_numpy()[x]), np.searchsorted(nodes, far["node"].to_numpy()[y])
        least = least_of_parts(a, b, len(nodes))
        moved = least != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[least[moved]]})

    return run


def _links_apart(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts of each family (hub, node, n, part).

    The largest part is the main one; blocks of other classes meet each other and blocks of it.
    """
    split = family.groupBy("hub").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    family = stage(family.join(split.select("hub"), "hub", "left_semi").select("hub", "node", "n", "part"), "families")
    parts = family.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("held"))
    mains = parts.groupBy("hub").agg(F.max_by("part", F.struct("held", -F.col("part"))).alias("main"))
    marked = family.join(mains, "hub").withColumn("outside", F.col("part") != F.col("main"))

    def blocks(outside: bool):
        of = F.col("outside") if outside else ~F.col("outside")
        held, volume = F.sum(of.cast("int")), F.sum(F.when(of, F.col("n")).otherwise(0))
        return F.ceil(F.greatest(held / BLOCK_SETS, volume / BLOCK_SHINGLES, F.lit(1))).cast("int")

    numbers = marked.groupBy("hub").agg(blocks(True).alias("outer"), blocks(False).alias("inner"))
    dealt = marked.join(numbers, "hub")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner"))).cast("int")
    dealt = dealt.withColumn("own", own)

    def tasks(count: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)

    def task(kind: str, i, j, first):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), first.alias("first"))

    among = tasks("outer", lambda k: task("outer", F.least(k, F.col("own")), F.greatest(k, F.col("own")), F.col("own") <= k))
    inward = tasks("inner", lambda k: task("inner", F.col("own"), k, F.lit(True)))
    outward = tasks("outer", lambda k: task("inner", k, F.col("own"), F.lit(False)))
    todo = F.when(F.col("outside"), F.concat(among, inward)).otherwise(outward)
    sent = dealt.select("hub", "node", "part", F.explode(todo).alias("task")).select("hub", "node", "part", "task.*")
    filled = sent.join(sets.withColumnRenamed("doc_id", "node"), "node")
    return filled.groupBy("hub", "kind", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are runs of characters other than space and ASCII blanks with A-Z folded. A set holds
    the distinct shingles of ``size`` words; a shorter text is one shingle; null, empty and blank
    texts have none and link with nothing. Sets are compared by 64-bit shingle hashes. Candidates
    share one of ``bands`` keys of ``rows`` coordinates (at 0.75, one pair in 180,000 does not);
    links are those with 100 * shared >= percent * union. Equal rows are copies of each other;
    rows that share a doc_id count as one document; rows without a doc_id link with nothing and
    have a null component. Only ``doc_id`` and ``text`` are read, other columns may have any name.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stage(sketches(docs, size, bands, rows), "sketches")
    able = marked.where("doc_id is not null and n > 0")
    classes = able.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("node"), F.min(F.struct("doc_id", "n", "bands")).alias("top")
    )
    nodes = stage(classes.select("set_a", "set_b", "node", "top.n", "top.bands"), "classes")

    # Buckets of two nodes or more, with the rank of a node: in how much company it is.
    entries = nodes.select(F.explode("bands").alias("key"), "node", "n")
    filled = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stage(entries.join(filled, "key"), "buckets")
    company = buckets.groupBy("node").agg(F.sum("members").alias("company"))
    by_rank = buckets.join(company, "node")
    hubs = by_rank.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"), "n")).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    buckets = stage(buckets.join(hubs, "key"), "buckets-hubs")

    wanted = docs.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stage(_shingles(wanted.dropDuplicates(["doc_id"]), size), "sets")

    spokes = buckets.where("node <> hub").where(_may_link("n", "hub_n", percent)).select(*_ordered("node", "hub"))
    linked = stage(_verified(spokes.distinct(), sets, percent), "links")
    joined = stage(components(linked), "components")

    family = buckets.select("hub", "node", "n").distinct().join(joined, "node", "left")
    more = stage(_links_apart(family.withColumn("part", F.coalesce("component", "node")), sets, percent), "more-links")
    if not more.isEmpty():
        joined = stage(components(linked.union(more)), "components")

    found = nodes.select("set_a", "set_b", "node").join(joined, "node", "left")
    found = found.select("set_a", "set_b", F.coalesce("component", "node").alias("least"))
    linked_rows = able.select("doc_id", "n", "set_a", "set_b").join(found, ["set_a", "set_b"]).select("doc_id", "n", "least")
    alone = marked.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("least"))
    return linked_rows.union(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("least").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"),
    )
