"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of a partition go to each shard has a known law when all rows are shuffled
uniformly: a row of a random matrix whose row sums are the partitions' counts and whose column
sums are the shards' sizes. The matrix is drawn first, rows move once, and sizes are exact.

The matrix is never built. Halving the partitions, a node splits each shard's places between its
halves by hypergeometric draws seeded by the node, so every task walks from the root to its own
partition in log2(partitions) steps and draws what all others draw. Partition and shard are both
permuted by keyed Feistel networks, which give one row's new place without the others: no task
holds a shard, and a shard's slots are known before the exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stage
from tidewatch.llm.hashing import mix

SEED = 20_260
# Rows of a shard that travel to one task and lie there in the order of their slots.
CHUNK = 512
_ROUNDS = 8
_ALL = (1 << 64) - 1


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart."""
    return rows // shards + (np.arange(shards) < rows % shards)


def hypergeometric(good: int, bad: int, drawn: int, u: float) -> int:
    """How many of ``drawn`` items out of ``good + bad`` are good, by inversion at ``u``.

    Probabilities follow from their ratios, outwards from the mode and as far as they matter to a
    double, so that counts of any size are drawn alike.
    """
    total = good + bad
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), least), most)
    spread = (drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5
    width = int(12 * spread) + 60
    k = np.arange(mode, min(most, mode + width), dtype=np.float64)
    up = np.cumprod((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1)))
    k = np.arange(mode, max(least, mode - width), -1, dtype=np.float64)
    down = np.cumprod(k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1)))
    mass = np.cumsum(np.concatenate((down[::-1], [1.0], up)))
    return mode - len(down) + min(int(np.searchsorted(mass, u * mass[-1], side="right")), len(mass) - 1)


class CommunicationMatrix:
    """Rows that each partition sends to each shard, drawn where they are asked for."""

    def __init__(self, counts: list[int], sizes: np.ndarray, seed: int):
        self.before = np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64))))
        self.sizes, self.seed = np.asarray(sizes, dtype=np.int64), seed
        self._split: dict[tuple[int, int], np.ndarray] = {}

    def _left(self, lo: int, hi: int, places: np.ndarray) -> np.ndarray:
        """The places of each shard that the first half of partitions lo..hi-1 fills."""
        if (lo, hi) not in self._split:
            drawn = int(self.before[(lo + hi) // 2] - self.before[lo])
            rest, out = int(places.sum()), np.empty_like(places)
            for s, u in enumerate(np.random.default_rng([self.seed, lo, hi]).random(len(places))):
                rest -= int(places[s])
                out[s] = hypergeometric(int(places[s]), rest, drawn, u)
                drawn -= int(out[s])
            self._split[lo, hi] = out
        return self._split[lo, hi]

    def row(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows this partition sends to each shard, and rows the ones before it send there."""
        lo, hi, places, earlier = 0, len(self.before) - 1, self.sizes, np.zeros_like(self.sizes)
        while hi - lo > 1:
            left, middle = self._left(lo, hi, places), (lo + hi) // 2
            if partition < middle:
                hi, places = middle, left
            else:
                lo, places, earlier = middle, places - left, earlier + left
        return places, earlier


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of position ``at`` in a pseudorandom permutation of 0..size-1 chosen by ``key``."""
    at, size, key = (np.broadcast_to(x, at.shape).astype(np.uint64) for x in (at, size, key))
    bits = np.frexp(np.maximum(size, 2).astype(np.float64) - 0.5)[1].astype(np.uint64)
    half = np.maximum((bits + np.uint64(1)) // np.uint64(2), np.uint64(1))
    low, out, todo = (np.uint64(1) << half) - np.uint64(1), at.copy(), np.arange(len(at))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(_ROUNDS):
            left, right = right, left ^ (mix(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & _ALL)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]  # beyond the end: on along the cycle
    return out.astype(np.int64)


def _keys(seed: int, kind: int, ids: np.ndarray) -> np.ndarray:
    start = np.uint64((seed * 4 + kind) * 0xD6E8FEB86659FD93 & _ALL)
    return mix(mix(ids.astype(np.uint64) + start) + start)


def _place(matrix: CommunicationMatrix, names: np.ndarray, p: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of the rows at positions ``pos`` of partitions ``p``."""
    shard, slot = np.empty(len(p), dtype=np.int64), np.empty(len(p), dtype=np.int64)
    for name in np.unique(p):
        here, index = np.flatnonzero(p == name), int(np.searchsorted(names, name))
        sent, earlier = matrix.row(index)
        ends = np.cumsum(sent)
        local = permuted(pos[here], ends[-1], _keys(matrix.seed, 1, np.array([index]))[0])
        to = np.searchsorted(ends, local, side="right")
        shard[here], slot[here] = to, earlier[to] + local - (ends - sent)[to]
    return shard, permuted(slot, matrix.sizes[shard], _keys(matrix.seed, 2, shard))


def shard_documents(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(row, shard, slot): every row of ``docs`` as a struct, dealt uniformly at random to ``shards`` shards.

    Shards are numbered from 0 and hold equally many rows, at most one apart; slots number the rows of
    a shard from 0 without gaps, in random order. Rows arrive in chunks of a shard, in slot order.
    Nulls, repeated rows, long texts and any column names are of no effect: rows are only moved, and
    repeated ones take a place each. With fewer rows than shards some shards stay empty; an empty
    table gives no rows. The rows are written once, which fixes their positions against retries; the
    same partitions and seed give the same places.
    """
    low = F.lit((1 << 33) - 1)
    at = F.monotonically_increasing_id().bitwiseAND(low)
    staged = stage(docs.select(F.struct(*docs.columns).alias("row"), F.spark_partition_id().alias("p"), at.alias("pos")), "shard-input")
    # One count per input partition reaches the driver: 16 bytes for each of its tasks.
    counts = sorted((r.p, r.n) for r in staged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect())
    names = np.array([p for p, _ in counts], dtype=np.int64)
    matrix = CommunicationMatrix([n for _, n in counts], shard_sizes(sum(n for _, n in counts), shards), seed)

    @F.pandas_udf("shard int, slot long")
    def place(p: pd.Series, pos: pd.Series) -> pd.DataFrame:
        shard, slot = _place(matrix, names, p.to_numpy(), pos.to_numpy())
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    placed = staged.withColumn("at", place("p", "pos")).select("row", "at.shard", "at.slot")
    return placed.repartition("shard", F.expr(f"slot div {CHUNK}")).sortWithinPartitions("shard", "slot")
