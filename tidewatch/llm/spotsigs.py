"""Document fingerprints by SpotSigs.

A spot is a common word; its signature chains the content words that follow it at a fixed distance.
Common words spread through running text and not through lists and navigation, so a document's set
of signatures follows its prose. The fingerprint is that set. Fingerprints are compared by Jaccard
only where their lengths allow the threshold, and a comparison stops once it cannot be reached.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, stage
from tidewatch.llm.hashing import mix, words_of

CHAIN, DISTANCE = 2, 1
THRESHOLD = 0.75
# Common words of the languages expected, fixed values.
SPOTS = (
    "the a an is was are were be of and to in it that this for on with by as at or from "
    "der die das ein eine ist war und zu in den dem von mit für auf im nicht sich "
    "le la les un une est et de des du en que qui dans pour par sur pas "
    "el los las un una es y en que por con del se para no"
)
_BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
# Most ranges that documents are dealt to in order of their ids.
MOST_RANGES, RANGE_DOCS = 4096, 2_000


@lru_cache(maxsize=1)
def _spot_hashes() -> np.ndarray:
    return np.unique(words_of(SPOTS.encode(), _BREAKS)[2])


def signatures(data: bytes, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text; a text without any has one of its own words.

    The content words of a chain are the first behind the spot and then every ``distance``-th.
    """
    _, _, hashes = words_of(data, _BREAKS)
    if not len(hashes):
        return np.empty(0, dtype=np.uint32)
    spots = _spot_hashes()
    common = spots[np.minimum(np.searchsorted(spots, hashes), len(spots) - 1)] == hashes
    content = hashes[~common]
    first = np.searchsorted(np.flatnonzero(~common), np.flatnonzero(common))
    whole = first + (chain - 1) * distance < len(content)
    first, sums = first[whole], hashes[common][whole]
    for k in range(chain):
        sums = mix(sums * np.uint64(0x9E3779B97F4A7C15) + content[first + k * distance])
    if not len(sums):  # the words in order, as one signature
        sums = mix(np.array([np.bitwise_xor.reduce(mix(hashes + np.arange(len(hashes), dtype=np.uint64)))]))
    return np.unique((sums >> np.uint64(32)).astype(np.uint32))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted distinct arrays, or 0 where it is known to be below ``least``.

    The sizes bound it from above; so does what is found up to a cut, with all that is left.
    """
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared, step = 0, max(64, len(a) // 8)
    for first in range(0, len(a), step):
        part = a[first : first + step]
        shared += int((b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part).sum())
        if least:
            left = min(len(a) - first - len(part), len(b) - shared)
            most = shared + max(left, 0)
            if most < least * (len(a) + len(b) - most):
                return 0.0
    return shared / (len(a) + len(b) - shared)


def fingerprint(found: np.ndarray) -> str:
    """The signatures as fixed-width hexadecimal, ascending."""
    return found.astype(">u4").tobytes().hex()


def signatures_of(print_: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(print_), dtype=">u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs`` (doc_id, text); null and empty texts have an empty one."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        found = [fingerprint(signatures((t or "").encode("utf-8", "surrogatepass"))) for t in texts]
        return {"doc_id": batch.column("doc_id"), "fingerprint": found}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(chosen, "text", "doc_id long, fingerprint string", work)


def similar_fingerprints(prints: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness) of documents (doc_id, fingerprint) alike by ``least`` or more, a < b, among the
    documents of least id of each distinct fingerprint; with ``copies`` telling how many have it.

    Lengths are cut into partitions of ratio ``least``, so partners are in the same or the next one;
    a pair meets through its rarest signatures (prefix filter), which also splits a large partition.
    Empty fingerprints are like nothing.
    """
    sets = prints.where("doc_id is not null and fingerprint <> ''").groupBy("fingerprint")
    sets = sets.agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    size = F.length("fingerprint") / 8
    at = F.sequence(F.lit(0), (size - 1).cast("int"))
    each = F.transform(at, lambda i: F.substr(F.col("fingerprint"), i * 8 + 1, F.lit(8)))
    part = F.floor(F.log(size) / F.lit(float(np.log(1 / least)))).cast("int")
    sets = stage(sets.select("id", "copies", size.cast("int").alias("n"), part.alias("part"), each.alias("s")), "prints")
    spread = sets.select("id", "n", "part", F.explode("s").alias("w"))
    rare = spread.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "w")
    ranked = spread.join(rare, "w").where("df > 1 or n = 1").withColumn("i", F.row_number().over(order))
    prefix = stage(ranked.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least) + 1), "prints-prefix")
    up = prefix.select("id", "n", "w", F.explode(F.array("part", F.col("part") + 1)).alias("at"))
    x, y = up.alias("x"), prefix.alias("y")
    may = (F.col("x.w") == F.col("y.w")) & (F.col("x.at") == F.col("y.part")) & (F.col("x.id") != F.col("y.id"))
    may &= F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * least
    met = x.join(y, may).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    for e in "ab":
        met = met.join(sets.select(F.col("id").alias(e), F.col("s").alias(f"{e}s"), F.col("copies").alias(f"{e}_copies")), e)
    shared = F.size(F.array_intersect("as", "bs"))
    likeness = shared / (F.size("as") + F.size("bs") - shared)
    found = met.select("a", "b", "a_copies", "b_copies", likeness.alias("likeness"))
    return found.where(F.col("likeness") >= least)


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """The range of an id: how many cuts are at or below it; null ids come first."""
    table = F.lit(",".join(map(str, cuts)))
    at = F.split(table, ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    steps = max(1, len(cuts)).bit_length()

    def halve(s, _):  # binary search
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(at, middle) <= doc_id
        go = s["lo"] < s["hi"]
        return F.struct(
            F.when(go & below, middle + 1).otherwise(s["lo"]).alias("lo"),
            F.when(go & ~below, middle).otherwise(s["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return F.when(doc_id.isNull(), 0).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``next_text``: that of the next larger doc_id, for the largest the first.

    Documents are dealt to ranges of ids of about RANGE_DOCS, at most MOST_RANGES; the first document
    of a range is also sent to the one before. Only the text's one shuffle and the cuts are needed.
    Null ids come first; rows of one id follow each other by their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total, low = ids.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, -(-total // RANGE_DOCS)))
    cuts: list[int] = []
    if ranges > 1 and low is not None:
        at = [i / ranges for i in range(1, ranges)]
        found = ids.agg(F.percentile_approx("doc_id", at, 10 * ranges)).first()[0]
        cuts = sorted({c for c in found if c > low})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("range", _range_of(F.col("doc_id"), cuts))
    # The first row of each range, by id and text: the least id of each, then the rows that have it.
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    held = sorted(tuple(r) for r in rows.groupBy("range").agg(F.min(key)).collect())  # MOST_RANGES at most
    order = [r for r, _ in held]  # the first range's goes to the last
    to = [(r, least, order[i - 1]) for i, (r, least) in enumerate(held)]
    to = F.broadcast(docs.sparkSession.createDataFrame(to, "range int, least long, to int"))
    firsts = rows.join(to, "range").where(key == F.col("least")).groupBy("to").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    sent = firsts.select(F.col("to").alias("range"), "first.doc_id", "first.text", F.lit(1).alias("guest"))
    both = rows.select("range", "doc_id", "text", F.lit(0).alias("guest")).union(sent.select("range", "doc_id", "text", "guest"))
    follows = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(follows)).where("guest = 0").select("doc_id", "text", "next_text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text, or all it has."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]
