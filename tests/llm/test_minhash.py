from __future__ import annotations

import re

import numpy as np

from tidewatch.llm import minhash
from tidewatch.llm.hashing import shingle_set, words_of

from .conftest import least_reachable

SCHEMA = "doc_id long, text string, n long, component long, node long, bands string"


def shingles(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {d: (len(sets[d]), c) for d, c in least_reachable(ids, links).items()}


def test_components_against_all_pairs(spark, babble, edit):
    base = babble(1, 150)
    rows = [(100, base)]
    # A large family around a base that has not the least id: many variants are not alike themselves.
    rows += [(i, edit(base, i, 1 + i % 5)) for i in range(60)]
    rows += [(200 + i, base.upper() + "  ") for i in range(5)]
    chain = babble(2, 200)
    for i in range(6):
        rows.append((300 + i, chain))
        chain = edit(chain, i, 4)
    rows += [(400 + i, babble(50 + i, 3 + i)) for i in range(20)]
    rows += [(500, "a b"), (501, "A  b"), (502, "b a"), (503, None), (504, ""), (505, " \t\n"), (506, "a b c d e"), (507, "é É")]
    wanted = expected(rows)
    table = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows] + [(None, base, 1, 2, 3, "x"), (500, "a b", 1, 2, 3, "x")], SCHEMA)
    out = minhash.near_duplicates(table)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = out.collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == wanted[100][0]
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_is_a_shifted_permutation():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    both = len(a) * 8 // 10
    b = np.concatenate([a[:both], np.unique(rng.integers(0, 1 << 63, len(a) - both, dtype=np.uint64))])
    agree = (minhash.signature(a, 512) == minhash.signature(b, 512)).mean()
    assert abs(agree - both / (2 * len(a) - both)) < 0.08
    ranks = minhash._permutations(128)[1]
    assert (ranks[5][1:] == ranks[6][:-1]).all() and len(np.unique(ranks[:, 0])) == minhash.UNIVERSE


def test_shared_counts_against_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 80)).astype(np.int64)) for _ in range(40)]
    got = minhash.shared_counts(sets[:15], sets[15:])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]


def test_words_across_windows():
    text = ("wort " * 300_000 + "x" * 2_500_000 + " ende").encode()
    starts, ends, hashes = words_of(text)
    assert len(starts) == 300_002 and ends[-2] - starts[-2] == 2_500_000
    assert len(np.unique(hashes)) == 3 and hashes[-1] == words_of(b"ENDE")[2][0]
    assert len(shingle_set(hashes[:3], 5)) == 1 and len(shingle_set(hashes[:0], 5)) == 0
