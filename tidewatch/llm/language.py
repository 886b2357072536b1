"""Language of a text by a conditional random field over its words.

Each line is a chain of words. A word's scores sum the weights of its character n-grams, its
affixes and, where the learned lexicon has it, of the word itself; transitions between languages
are learned too, so a text may switch. Forward-backward gives every word a distribution, and the
text gets the language with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, pieces
from tidewatch.llm.crf import Adam, Chain, forward_backward, gold_counts
from tidewatch.llm.hashing import mix, words_of

# Bounds of the training sample: documents of each language, characters of each. With many languages
# each has an equal share of ALL_DOCS, and no fewer than LEAST_DOCS; the number of languages has no bound.
TRAIN_DOCS, TRAIN_CHARS, ALL_DOCS, LEAST_DOCS = 300, 1_500, 4_800, 8
TABLE = 1 << 16
LEXICON_LEAST = 3
EPOCHS = 40
UNDEFINED = "und"
_LETTER = regex.compile(r"\p{L}")
# ASCII other than letters ends a word.
BREAKS = bytes(b for b in range(128) if not chr(b).isalpha())
_GROUP = 1 << 20
# Numbers (words by languages) that one step holds, and weights of one table.
_CELLS, _WEIGHTS = 1 << 22, 1 << 23
# Bytes of text that the pipeline judges at once, beside what later stages keep in the same worker.
_JUDGED_BYTES = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    grams: np.ndarray  # (TABLE or a smaller power of two, languages)
    affixes: np.ndarray  # as grams
    words: np.ndarray  # sorted hashes of the lexicon
    word_weights: np.ndarray
    chain: Chain


_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[list(BREAKS)] = 1


def word_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of ``data``: starts, ends, hashes, gram slots per byte of it, affix slots (words, 4)."""
    starts, ends, hashes = words_of(data, BREAKS)
    raw = np.frombuffer(b"\n\n" + data + b"\n\n\n\n", dtype=np.uint8)
    low = _FOLD[raw]
    # A gram covers a byte and its neighbours; at the edge of a word one of them is the break.
    grams = low[1:-5] | low[2:-4] << np.uint64(8) | low[3:-3] << np.uint64(16)
    grams = (mix(grams) % np.uint64(TABLE)).astype(np.int32)
    s, e = starts + 2, ends + 2
    one, two, three = np.uint64(8), np.uint64(16), np.uint64(24)
    long_word = (ends - starts >= 3).astype(np.uint64)
    affixes = np.stack(
        [
            low[s] | low[s + 1] << one | np.uint64(1) << three,
            (low[s] | low[s + 1] << one | low[s + 2] << two) * long_word | np.uint64(2) << three,
            low[e - 1] | low[e - 2] << one | np.uint64(3) << three,
            (low[e - 1] | low[e - 2] << one | low[e - 3] << two) * long_word | np.uint64(4) << three,
        ],
        axis=1,
    )
    return starts, ends, hashes, grams, (mix(affixes) % np.uint64(TABLE)).astype(np.int32)


def _emissions(model: LanguageModel, starts, ends, hashes, grams, affixes) -> np.ndarray:
    fold = len(model.grams) - 1
    out = np.zeros((len(starts), len(model.languages)), dtype=np.float32)
    for column in affixes.T:
        out += model.affixes[column & fold]
    if len(model.words):
        slot = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
        known = model.words[slot] == hashes
        out[known] += model.word_weights[slot[known]]
    # Sums of gram weights per word, some words at a time.
    most = max(1, _GROUP // len(model.languages))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most)))
        a, b = starts[first], ends[last - 1]
        sums = np.zeros((b - a + 1, out.shape[1]), dtype=np.float32)
        np.cumsum(model.grams[grams[a:b] & fold], axis=0, out=sums[1:])
        out[first:last] += sums[ends[first:last] - a] - sums[starts[first:last] - a]
        first = last
    return out


def _line_lengths(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Words per line."""
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    cuts = np.searchsorted(starts, np.concatenate([[0], breaks, [len(data)]]))
    return np.diff(cuts)


def _blocks(lengths: np.ndarray, most: int) -> Iterator[tuple[slice, slice]]:
    """Runs of lines of up to ``most`` words, or of one line, and their words."""
    ends = np.cumsum(lengths)
    first, word = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, word + most, side="right")))
        if ends[last - 1] > word:
            yield slice(first, last), slice(word, int(ends[last - 1]))
        first, word = last, int(ends[last - 1])


def word_marginals(model: LanguageModel, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and their distributions over the languages."""
    found = word_features(data)
    marginal = forward_backward(_emissions(model, *found), _line_lengths(data, found[0]), model.chain)[0]
    return found[0], found[1], marginal


def train(texts: list[str], languages: list[str]) -> LanguageModel:
    """Fit to texts whose words all have their text's language; deterministic."""
    names = tuple(sorted(set(languages)))
    number = {n: i for i, n in enumerate(names)}
    k = len(names)
    coded = [t.replace("\n", " \n").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(coded)
    starts, ends, hashes, grams, affixes = word_features(data)
    begins = np.cumsum([0] + [len(c) + 1 for c in coded])
    labels = np.array([number[x] for x in languages], dtype=np.int64)
    labels = labels[np.searchsorted(begins, starts, side="right") - 1] if k else labels
    lexicon, seen = np.unique(hashes, return_counts=True)
    lexicon, seen = lexicon[seen >= LEXICON_LEAST], seen[seen >= LEXICON_LEAST]
    # With many languages the tables have fewer rows, and the lexicon keeps its most common words.
    lexicon = np.sort(lexicon[np.argsort(-seen, kind="stable")[: max(1, _WEIGHTS // max(k, 1))]])
    table = TABLE
    while table * k > _WEIGHTS and table > 1 << 10:
        table //= 2
    model = LanguageModel(
        names, np.zeros((table, k), np.float32), np.zeros((table, k), np.float32), lexicon,
        np.zeros((len(lexicon), k), np.float32), Chain.flat(k),
    )
    if k < 2 or not len(starts):
        return model
    lengths = _line_lengths(data, starts)
    moves, first = gold_counts(labels, lengths, k)
    slot = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
    known = lexicon[slot] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    steps = Adam([model.grams, model.affixes, model.word_weights, model.chain.move, model.chain.start], 0.05)
    n = len(starts)
    for _ in range(EPOCHS):
        by_gram, by_affix, by_word = np.zeros((table, k)), np.zeros((table, k)), np.zeros((len(lexicon), k))
        gone, begun = np.zeros((k, k)), np.zeros(k)
        for lines, at in _blocks(lengths, max(1, _CELLS // k)):
            begin, end = starts[at], ends[at]
            marginal, _, moved, led = forward_backward(
                _emissions(model, begin, end, hashes[at], grams, affixes[at]), lengths[lines], model.chain, count_moves=True
            )
            gap = -marginal
            gap[np.arange(len(gap)), labels[at]] += 1
            gap /= n
            size = end - begin
            inside = np.repeat(np.arange(len(size)), size)
            gram_slots = grams[np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size) + begin[inside]] & (table - 1)
            affix_slots, met = affixes[at].ravel() & (table - 1), known[at]
            for j in range(k):
                by_gram[:, j] += np.bincount(gram_slots, gap[inside, j], table)
                by_affix[:, j] += np.bincount(affix_slots, np.repeat(gap[:, j], affixes.shape[1]), table)
                by_word[:, j] += np.bincount(slot[at][met], gap[met, j], len(lexicon))
            gone += moved
            begun += led
        steps.ascend(
            [
                by_gram - 1e-6 * model.grams, by_affix - 1e-6 * model.affixes, by_word - 1e-6 * model.word_weights,
                (moves - gone) / n - 1e-4 * model.chain.move, (first - begun) / n - 1e-4 * model.chain.start,
            ]
        )
    return model


def sample_docs(languages: int) -> int:
    """Documents to learn from of each of so many languages."""
    return max(LEAST_DOCS, min(TRAIN_DOCS, ALL_DOCS // max(languages, 1)))


def fit_language_model(docs: DataFrame, learn_from: Column) -> LanguageModel:
    """Train on a bounded sample of the rows of ``docs`` (doc_id, text, lang) where ``learn_from`` holds.

    Every non-null language is learned. The sample has the documents of least hash of each, as many
    as ``sample_docs`` says, and whole lines of each up to about TRAIN_CHARS characters.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(learn_from)
    most = sample_docs(rows.select("lang").distinct().count())
    ranked = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang")
    chosen = ids.withColumn("turn", F.row_number().over(ranked)).where(F.col("turn") <= most)
    sample = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    part = F.substring("text", 1, 4 * TRAIN_CHARS).alias("text")
    held = [tuple(r) for r in sample.select("doc_id", part, "lang").collect()]
    texts, names, seen = [], [], {}
    for _, text, lang in sorted(held, key=lambda r: (r[0], r[1], r[2])):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= most:  # rows may share a doc_id
            cut = text.find("\n", TRAIN_CHARS)
            texts.append(text if cut < 0 else text[:cut])
            names.append(lang)
    return train(texts, names)


def _judged(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language and score of each text, and how sure its words are: their greatest marginals, by length."""
    names, scores, sure, k = [], [], [], len(model.languages)
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not k:
        return [UNDEFINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    data = b"\n".join(coded)
    starts, ends, hashes, grams, affixes = word_features(data)
    owner = np.searchsorted(np.cumsum([len(c) + 1 for c in coded]), starts, side="right")
    sums, tops = np.zeros((len(texts), k)), np.zeros(len(texts))
    lengths = _line_lengths(data, starts)
    for lines, at in _blocks(lengths, max(1, _CELLS // k)):
        emit = _emissions(model, starts[at], ends[at], hashes[at], grams, affixes[at])
        marginal = forward_backward(emit, lengths[lines], model.chain)[0]
        own, cuts = np.unique(owner[at], return_index=True)
        size = (ends - starts)[at]
        sums[own] += np.add.reduceat(marginal * size[:, None], cuts, axis=0)
        tops[own] += np.add.reduceat(marginal.max(axis=1) * size, cuts)
    for i, text in enumerate(texts):
        of = sums[i]
        whole = of.sum()
        if whole <= 0 or not _LETTER.search(text):
            names.append(UNDEFINED)
            scores.append(0.0)
            sure.append(0.0)
        else:
            best = int(np.argmax(np.round(of / whole, 9)))
            names.append(model.languages[best])
            scores.append(float(min(1.0, of[best] / whole)))
            sure.append(float(min(1.0, tops[i] / whole)))
    return names, scores, sure


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text).

    ``score`` is the share of the text's letters, weighted by their words' marginals, that the
    predicted language has. Texts that are null or have no letter are ``und`` with score 0, as are
    all texts where no language was learned. Ties go to the language first by name. Repeated rows
    are judged each; other columns are not read.
    """
    def work(batch: pa.RecordBatch) -> dict:
        names, scores, _ = _judged(model, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(chosen, "text", "doc_id long, lang_pred string, score double", work)


def keep_known_languages(docs: DataFrame, model: LanguageModel, least_sure: float) -> DataFrame:
    """The rows of ``docs`` with a letter whose words' languages are known with ``least_sure``, with all columns.

    Sure is the mean of the words' greatest marginals, weighted by length: a text of several languages
    stays where each word's own is clear. Where no language was learned, every text with a letter stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", _JUDGED_BYTES):
            texts = piece.column("text").to_pylist()
            if model.languages:
                kept = [s >= least_sure and s > 0 for s in _judged(model, texts)[2]]
            else:
                kept = [bool(_LETTER.search(t or "")) for t in texts]
            yield piece.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
