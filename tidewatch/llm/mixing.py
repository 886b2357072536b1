"""Mixing sources to target weights by balanced sampling (the cube method).

A source whose target is r times its size takes every document floor(r) times, and once more
those that a balanced sample with inclusion probability r - floor(r) draws. The flight phase moves
the probabilities of a few documents at a time along a direction that changes neither the expected
number of documents nor the expected number of words, until they are 0 or 1. It runs in blocks of
bounded size; what a block leaves undecided, two documents at most, goes to the next round, until
each source has one block, whose rest is the landing problem.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stage, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 5_000
MAX_SOURCES = 100_000
TINY = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MOST) -> dict[str | None, float]:
    """Words to take per source.

    Sources by code point, null last, have the weights in turn. They share ``share`` times all words
    by weight; none gets more than ``most`` times its size, and what it leaves is shared among
    the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: most * size for s, size in order}
    left, free, out = share * sum(size for _, size in order), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > limit[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = limit[s]
            left -= limit[s]
        free = [s for s in free if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Decide all but at most two probabilities, keeping sum(p) and sum(p * size).

    Three undecided documents are moved at a time; ``draw`` holds a uniform number per document,
    which chooses the sense of the move so that expectations are kept.
    """
    p = p.copy()
    scale = max(float(size.max(initial=1.0)), 1.0)
    held: list[int] = []
    for k in range(len(p)):
        if not TINY < p[k] < 1 - TINY:
            p[k] = round(p[k])
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        # The cross product of (1, 1, 1) and the sizes is orthogonal to both.
        x, y, z = size[a] / scale, size[b] / scale, size[c] / scale
        u = np.array([z - y, x - z, y - x])
        if np.abs(u).max() < 1e-12:
            u = np.array([1.0, -1.0, 0.0])
        up, down = np.inf, np.inf
        for i, v in zip(held, u, strict=True):
            if v > 1e-15:
                up, down = min(up, (1 - p[i]) / v), min(down, p[i] / v)
            elif v < -1e-15:
                up, down = min(up, p[i] / -v), min(down, (1 - p[i]) / -v)
        step = up if draw[k] * (up + down) < down else -down
        for i, v in zip(held, u, strict=True):
            p[i] += step * v
            if not TINY < p[i] < 1 - TINY:
                p[i] = round(p[i])
        held = [i for i in held if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last documents: of all ways, the one whose words come nearest to the expected."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    wanted, documents = (p[open_] * size[open_]).sum(), p[open_].sum()
    ways = product((0.0, 1.0), repeat=len(open_))
    p[open_] = min(ways, key=lambda w: (abs((w * size[open_]).sum() - wanted), abs(sum(w) - documents)))
    return p


def _fly(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "doc_id", "size"], kind="stable")
        p = flight(rows["p"].to_numpy(float), rows["size"].to_numpy(float), rows["draw"].to_numpy(float))
        return rows.assign(p=land(p, rows["size"].to_numpy(float)) if last else p)

    return run


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words, 0 for null and empty text; documents without words and those of
    sources without words are taken as often as chance has it, which costs no words. The number of
    sources is bounded by MAX_SOURCES, as they are listed on the driver; a source of any size is sampled in blocks of
    about ``block`` documents, dealt by a hash of doc_id and seed, so reruns agree. Documents with the
    same doc_id and size are interchangeable. A null source is a source, the last.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    sized = stage(marked, "sizes")
    totals = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"{len(totals)} sources; the mix lists at most {MAX_SOURCES} on the driver")
    wanted = targets([(s, size) for s, size, _ in totals], weights, share, most)
    # The number of blocks follows the source's documents, so a hot source is many blocks.
    facts = [(s, size, float(wanted[s]), wanted[s] / size if size else min(1.0, most), 1 + n // block) for s, size, n in totals]
    facts = spark.createDataFrame(facts, "source string, source_size long, target double, rate double, blocks long")
    rows = sized.join(F.broadcast(facts), sized["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    draw = (F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    whole = F.floor("rate")
    current = rows.select(
        "doc_id", "source", "size", "source_size", "target", whole.alias("base"), (F.col("rate") - whole).alias("p"), draw,
        F.pmod(F.xxhash64("size", "doc_id", F.lit(seed + 1)), F.col("blocks")).alias("block"), "blocks",
    )
    schema, done = current.schema, []
    while True:
        settled = (F.col("p") <= TINY) | (F.col("p") >= 1 - TINY)
        done.append(current.where(settled))
        pending = current.where(~settled)
        widest = pending.agg(F.max("blocks")).first()[0]
        if widest is None:
            break
        last = widest == 1
        # Sources that are down to one block land only in the last round, so all rounds are shared.
        flown = pending.groupBy("source", "block").applyInPandas(_fly(last), schema)
        fewer = F.ceil(F.col("blocks") / F.lit(block // 4)).cast("long")
        flown = flown.withColumns({"blocks": fewer, "block": F.pmod("block", fewer)})
        current = stage(flown, "flight")
        if last:
            done.append(current)
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    copies = (F.col("base") + F.round("p")).cast("long").alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies)


def repeated(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows that share doc_id, source and size share their copies out evenly, in a fixed order.
    """
    mixed = mix_sources(docs, weights, share, most, seed)
    wanted = mixed.groupBy(F.struct("doc_id", "source", "size").alias("key")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    names = docs.columns
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    joined = docs.select(F.struct(*names).alias("row"), key.alias("key")).join(wanted, "key")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(turn <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    taken = joined.select("row", each.cast("int").alias("each")).where("each > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "each"))).select("row.*")
