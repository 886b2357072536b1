"""The conditional random field, and its two uses: language and quality."""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import language, quality
from tidewatch.llm.crf import Chain, forward_backward, gold_counts
from tidewatch.llm.queries import op6_quality, op8_language

FOLDER = "/root/testdata/sf0.01"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    lengths, k = np.array([3, 0, 1, 4, 2]), 3
    emit = rng.normal(size=(lengths.sum(), k))
    chain = Chain(rng.normal(size=k), rng.normal(size=(k, k)))
    marginal, log_sum, moves, first = forward_backward(emit, lengths, chain, count_moves=True)
    wanted, wanted_moves, wanted_first, total, at = np.zeros_like(emit), np.zeros((k, k)), np.zeros(k), 0.0, 0
    for n in lengths:
        paths = list(product(range(k), repeat=n)) if n else []
        scores = [chain.start[p[0]] + sum(emit[at + i, s] for i, s in enumerate(p)) + sum(chain.move[a, b] for a, b in zip(p, p[1:])) for p in paths]
        if n:
            weights = np.exp(scores) / np.exp(scores).sum()
            total += np.log(np.exp(scores).sum())
            for p, w in zip(paths, weights, strict=True):
                wanted_first[p[0]] += w
                for i, s in enumerate(p):
                    wanted[at + i, s] += w
                for a, b in zip(p, p[1:]):
                    wanted_moves[a, b] += w
        at += n
    assert np.allclose(marginal, wanted) and np.allclose(moves, wanted_moves) and np.allclose(first, wanted_first)
    assert log_sum == pytest.approx(total)
    assert gold_counts(np.array([0, 1, 1, 2]), np.array([3, 1]), 3)[0].tolist() == [[0, 1, 0], [0, 1, 0], [0, 0, 0]]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    got = op8_language(spark, FOLDER).collect()
    assert len(got) == len(truth) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_of_odd_texts(spark):
    texts = ["the cat and the dog of the house", "der hund und die katze von dem haus"] * 20
    model = language.train(texts, ["en", "de"] * 20)
    schema = "doc_id long, text string, letters string, score string"
    rows = [(1, None), (2, ""), (3, "12 34 !"), (4, "der hund\nund das haus"), (5, "the dog"), (5, "the dog"), (None, "the cat"), (6, "？、。"), (7, "the house " * 30_000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = {(r.doc_id, r.lang_pred): r.score for r in language.predict_language(table, model).collect()}
    assert set(got) == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (None, "en"), (6, "und"), (7, "en")}
    assert got[1, "und"] == 0.0 and got[5, "en"] > 0.8
    kept = language.keep_known_languages(table, model, 0.4)
    assert kept.columns == table.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "5", "7", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language.fit_language_model(empty, F.lit(True))
    assert nothing.languages == () and language.predict_language(empty, nothing).count() == 0
    assert {r.lang_pred for r in language.predict_language(table, nothing).collect()} == {"und"}
    # A text that switches: each part's words lean to their own language.
    data = b"the dog of the house\nund die katze von dem hund"
    marginal = language.word_marginals(model, data)[2]
    assert marginal[:5, model.languages.index("en")].mean() > 0.7 and marginal[5:, model.languages.index("de")].mean() > 0.7


def test_every_language_is_learned(spark):
    # 70 languages of eight words each, every fourth document held out.
    rng, rows = np.random.default_rng(1), []
    for number in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)]
        for copy in range(4):
            rows.append((len(rows), " ".join(rng.choice(words, 12)), f"l{number:02}", copy == 3))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean")
    model = language.fit_language_model(table, ~F.col("held"))
    assert len(model.languages) == 70
    got = {r.doc_id: r.lang_pred for r in language.predict_language(table, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, held in rows if held]) > 0.97
    assert [language.sample_docs(n) for n in (0, 4, 16, 100, 10_000)] == [300, 300, 300, 48, 8]


def test_mixture_is_not_doubt(spark):
    letters = {"l0": "abcde", "l1": "fghij", "l2": "klmno", "l3": "pqrst"}
    rng = np.random.default_rng(2)

    def words(lang, n):
        return " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))

    names = list(letters) * 20
    model = language.train([words(x, 30) for x in names], names)
    mixed = "\n".join(words(x, 30) for x in letters)
    rows = [(1, mixed), (2, words("l1", 30)), (3, "12 ?"), (4, None), (5, "uvwxyz")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in language.predict_language(table, model).collect()}
    assert score[1] < 0.4 and score[5] < 0.4
    assert sorted(r.doc_id for r in language.keep_known_languages(table, model, 0.4).collect()) == [1, 2]
    nothing = language.train([], [])
    assert sorted(r.doc_id for r in language.keep_known_languages(table, nothing, 0.4).collect()) == [1, 2, 5]
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, unlabelled, "").collect()) == [1, 2, 5]


def test_blocks_of_lines_do_not_change_the_model(monkeypatch):
    texts = ["the cat and\nthe dog of the house", "der hund und\n\ndie katze von dem haus", "le chien et\nle chat"] * 9
    whole = language.train(texts, ["en", "de", "fr"] * 9)
    judged = language._judged(whole, [*texts, None, "", "\n"])
    monkeypatch.setattr(language, "_CELLS", 12)
    parts = language.train(texts, ["en", "de", "fr"] * 9)
    assert np.allclose(whole.grams, parts.grams, atol=1e-3) and np.allclose(whole.chain.move, parts.chain.move, atol=1e-3)
    again = language._judged(whole, [*texts, None, "", "\n"])
    assert judged[0] == again[0] and np.allclose(judged[1], again[1])
    monkeypatch.setattr(language, "_WEIGHTS", 3 << 12)
    small = language.train(texts, ["en", "de", "fr"] * 9)
    assert small.grams.shape == (1 << 12, 3) and language._judged(small, texts)[0] == ["en", "de", "fr"] * 9


def test_quality_of_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = {r.doc_id: r for r in op6_quality(spark, FOLDER).collect()}
    assert len(got) == 1000 and all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    held = [d for d in truth if got[d].held_out]
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, score string, predicted string"
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "a"), (4, "word " * 200_000), (4, "word " * 200_000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality_model(table, labels, F.lit(True)) is None
    assert {r.score for r in quality.score_quality(table, None).collect()} == {0.5}
    features, size, counts = quality.document_lines(["Good line here.\nAnother one.", "!! BAD !!", "", None] * 10)
    model = quality.train(features, size, counts, np.array([1, 0, 1, 0] * 10), np.ones(40))
    got = quality.score_quality(table, model).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 4}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(spark.createDataFrame([], schema), model).count() == 0
