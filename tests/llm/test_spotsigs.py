from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tidewatch.llm import spotsigs
from tidewatch.llm.queries import op7_fingerprints

FOLDER = "/root/testdata/sf0.001"


def test_signatures():
    of = lambda text: spotsigs.signatures(text.encode())
    assert len(of("")) == 0 and len(of(" ,. ")) == 0
    # Three spots with two content words behind them; "the" and "of" share their chain, not their signature.
    assert len(of("The of cat sat on mat today")) == 3
    assert (of("the cat sat") == of("THE cat, sat!")).all() and not np.isin(of("the cat sat"), of("the cat ran")).any()
    # Too short for a chain: one signature of all words in order.
    assert len(of("cat")) == 1 and len(of("cat dog")) == 1 and of("cat dog")[0] != of("dog cat")[0]
    print_ = spotsigs.fingerprint(of("the cat sat on a mat today"))
    assert (spotsigs.signatures_of(print_) == of("the cat sat on a mat today")).all()


def test_pruned_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(0, 300))) for _ in range(2))
        whole = len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) or len(b) else 1.0
        assert spotsigs.pruned_jaccard(a, b) == pytest.approx(whole)
        assert spotsigs.pruned_jaccard(a, b, 0.3) == pytest.approx(whole if whole >= 0.3 else 0.0) or whole < 0.3


def test_query_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_DOCS", 20)
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in op7_fingerprints(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        sets = [set(spotsigs.signatures(t.encode()).tolist()) for t in (text, changed, following)]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert r.near_next == pytest.approx(len(sets[0] & sets[2]) / len(sets[0] | sets[2]))


def test_next_of_odd_rows(spark):
    schema = "doc_id long, text string, range string, guest string"
    rows = [(5, "e"), (5, "e"), (-3, None), (None, "n"), (9, ""), (7, "é" * 100_000)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in spotsigs.with_next(table).collect()), key=str)
    long_text = "é" * 100_000
    wanted = [(False, 0, "n", None), (True, -3, None, "e"), (True, 5, "e", "e"), (True, 5, "e", long_text), (True, 7, long_text, ""), (True, 9, "", "n")]
    assert got == sorted(wanted, key=str)
    assert spotsigs.with_next(spark.createDataFrame([], schema)).count() == 0
    assert spotsigs.with_next(table.where("text = 'n'")).first().next_text == "n"


def test_similar_fingerprints(spark, babble, edit):
    common = "the " + " the ".join(babble(3, 240).split(" "))
    texts = {i: edit(common, i, 3 * i) for i in range(12)} | {50: common, 60: "", 61: "the big cat", 62: "the big cat"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {d: frozenset(spotsigs.signatures(t.encode()).tolist()) for d, t in texts.items() if t}
    least = {s: min(d for d in sets if sets[d] == s) for s in sets.values()}
    reps = sorted(set(least.values()))
    wanted = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    found = spotsigs.similar_fingerprints(spotsigs.fingerprints(table)).collect()
    assert wanted and {(r.a, r.b) for r in found} == wanted
