"""Quality of a text by a conditional random field over its lines.

Every line is labelled good or bad from its own features and those of the lines next to it, with
learned transitions; forward-backward gives each line the probability of being good, and their
mean, weighted by length, is calibrated to the share of good documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map
from tidewatch.llm.crf import Adam, Chain, forward_backward, gold_counts
from tidewatch.llm.hashing import mix, words_of

# Bounds of the training sample: documents of each label, and lines in all.
TRAIN_DOCS, TRAIN_LINES = 1_500, 80_000
EPOCHS = 150
THRESHOLD = 0.3
# Common words of the languages expected, fixed values.
COMMON = (
    "the of and to in is that for it with as on by be are this an or from at "
    "der die das und ist von zu mit den im für auf ein eine nicht des sich dem "
    "le la les de des et un une que qui en est pour dans sur par du au pas "
    "el los las y que en un una por con del se es no para al su"
)
_GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".,;:", b"!?",
    b"#$%&*+=<>^~@_\\/", b"|", b"\"'()[]{}`-",
)
_GROUP_OF = np.zeros(256, dtype=np.uint8)
for _i, _bytes in enumerate(_GROUPS):
    _GROUP_OF[list(_bytes)] = _i + 1
_WORDISH = bytes(b for b in range(128) if not chr(b).isalnum())


def _common_hashes() -> np.ndarray:
    return np.sort(words_of(COMMON.encode())[2])


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines of ``data`` (cut at line feeds): features (lines, n), and bytes without the feed."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.concatenate([np.flatnonzero(raw == 10), [len(raw)]])
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = ends - begins
    per = np.maximum(size, 1).astype(float)
    group = _GROUP_OF[raw]
    shares = []
    for g in range(1, len(_GROUPS) + 1):
        sums = np.concatenate([[0], np.cumsum(group == g, dtype=np.int64)])
        shares.append((sums[ends] - sums[begins]) / per)
    starts, stops, hashes = words_of(data, _WORDISH)
    cuts = np.searchsorted(starts, np.concatenate([begins, [len(raw) + 1]]))
    words = np.diff(cuts)
    of = np.repeat(np.arange(len(ends)), words)
    many = np.maximum(words, 1).astype(float)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, len(ends)) / many

    length = (stops - starts).astype(float)
    common = _common_hashes()
    usual = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    # Distinct words of a line: sort by line and hash.
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(of), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, len(ends)) / many
    gap = np.ones(len(starts))
    gap[1:] = starts[1:] - stops[:-1]
    wide = mean((gap > 2).astype(float))
    first = raw[np.minimum(begins, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(ends), np.uint8)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(len(ends), np.uint8)
    filled = size > 0
    columns = [
        *shares,
        np.log1p(size) / 8,
        np.log1p(words) / 6,
        mean(length) / 10,
        np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10,
        mean(usual.astype(float)),
        distinct,
        wide,
        ((first >= 65) & (first <= 90) & filled).astype(float),
        ((last == ord(".")) & filled).astype(float),
        (words == 0).astype(float),
    ]
    return np.stack(columns, axis=1), size


def document_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of the lines beside them, byte lengths, lines per text."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([c.count(b"\n") + 1 for c in coded])
    own, size = line_features(b"\n".join(coded))
    begins = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begins] = 0
    after[begins + counts - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[begins, 0] = 1
    edge[begins + counts - 1, 1] = 1
    return np.concatenate([own, own**2, before, after, edge, np.ones((len(own), 1))], axis=1), size, counts


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # score of "good"; "bad" scores 0
    chain: Chain
    slope: float
    offset: float


def _line_good(model: QualityModel, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    good = (features - model.center) / model.spread @ model.weights
    emit = np.stack([np.zeros(len(good)), np.clip(good, -30, 30)], axis=1)
    return forward_backward(emit, counts, model.chain)[0][:, 1]


def _weighted(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean per text as log-odds; a text without bytes counts its lines alike."""
    begins = np.cumsum(counts) - counts
    weight = size.astype(float)
    empty = np.add.reduceat(weight, begins) == 0
    weight[np.repeat(empty, counts)] = 1.0
    mean = np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def score_texts(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    """Calibrated probability of the good label per text."""
    features, size, counts = document_lines(texts)
    odds = _weighted(_line_good(model, features, counts), size, counts)
    return 1 / (1 + np.exp(-(model.slope * odds + model.offset)))


def train(features: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> QualityModel:
    """Fit to documents whose lines all have the document's label; ``weights`` restore the labels' shares."""
    center = features.mean(axis=0)
    spread = features.std(axis=0)
    center[spread < 1e-9], spread[spread < 1e-9] = 0.0, 1.0
    scaled = (features - center) / spread
    truth = np.repeat(labels, counts)
    w, chain = np.zeros(features.shape[1]), Chain.flat(2)
    moves, first = gold_counts(truth, counts, 2)
    steps, n = Adam([w, chain.move, chain.start], 0.05), len(truth)
    for _ in range(EPOCHS):
        emit = np.stack([np.zeros(n), np.clip(scaled @ w, -30, 30)], axis=1)
        marginal, _, expected, begun = forward_backward(emit, counts, chain, count_moves=True)
        steps.ascend(
            [
                scaled.T @ (truth - marginal[:, 1]) / n - 1e-3 * w,
                (moves - expected) / n - 1e-3 * chain.move,
                (first - begun) / n - 1e-3 * chain.start,
            ]
        )
    model = QualityModel(center, spread, w, chain, 1.0, 0.0)
    odds = _weighted(_line_good(model, features, counts), size, counts)
    line = np.array([0.5, 0.0])
    steps = Adam([line], 0.05)
    for _ in range(400):
        gap = weights * (labels - 1 / (1 + np.exp(-(line[0] * odds + line[1]))))
        steps.ascend([np.array([(gap * odds).mean(), gap.mean()]) - 1e-3 * line])
    return QualityModel(center, spread, w, chain, float(max(line[0], 1e-3)), float(line[1]))


def fit_quality_model(docs: DataFrame, labels: DataFrame, learn_from: Column) -> QualityModel | None:
    """Train on a bounded sample of ``docs`` (doc_id, text) with ``labels`` (doc_id, quality) of 0 or 1.

    Only rows of ``labels`` where ``learn_from`` holds are read: of each label the TRAIN_DOCS of least
    hash, up to TRAIN_LINES lines in all. None where one of the labels has no document.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null")
    rows = rows.where("quality in (0, 1)").where(learn_from).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    totals = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(totals) < 2:
        return None
    chosen = [rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for q in (0, 1)]
    marks = {r[0]: r[1] for r in chosen[0].union(chosen[1]).collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in marks], "doc_id long")  # at most 2 * TRAIN_DOCS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def work(batch: pa.RecordBatch) -> dict:
        features, size, counts = document_lines(batch.column("text").to_pylist())
        cuts = np.cumsum(counts)[:-1]
        return {
            "doc_id": batch.column("doc_id"),
            "features": [x.astype(np.float32).ravel() for x in np.split(features, cuts)],
            "sizes": np.split(size, cuts),
        }

    held = arrow_map(texts, "text", "doc_id long, features array<float>, sizes array<long>", work)
    held = held.withColumn("lines", F.size("sizes")).where(F.col("lines") <= TRAIN_LINES // 20)
    kept, seen, lines = [], set(), 0
    found = held.select("doc_id", "features", "sizes").toPandas().itertuples(index=False)
    for doc_id, features, sizes in sorted(found, key=lambda r: (hash_order(r[0]), r[0])):
        if doc_id not in seen and lines + len(sizes) <= TRAIN_LINES:
            seen.add(doc_id)
            lines += len(sizes)
            kept.append((marks[doc_id], np.asarray(features, float).reshape(len(sizes), -1), np.asarray(sizes)))
    y = np.array([k[0] for k in kept])
    if len(np.unique(y)) < 2:
        return None
    weight = np.array([totals[q] / sum(totals.values()) / (y == q).mean() for q in y])
    counts = np.array([len(k[2]) for k in kept])
    return train(np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept]), counts, y, weight)


def hash_order(doc_id: int) -> int:
    """A fixed shuffle of ids."""
    return int(mix(np.array([doc_id], dtype=np.int64).view(np.uint64))[0])


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text).

    Null and empty texts are one empty line. Without a model every score is 0.5. Repeated rows are
    scored each, and alike; only ``doc_id`` and ``text`` are read.
    """

    def work(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        scores = np.full(len(texts), 0.5) if model is None else score_texts(model, texts)
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(chosen, "text", "doc_id long, score double, predicted int", work)
