"""Sharding: exact sizes, a uniform law, and the pieces against brute force."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import product
from math import comb

import numpy as np
import pytest

from tidewatch.llm import sharding as sh


def check(rows, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert set(by_shard) <= set(range(shards)) and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize(("good", "bad", "drawn"), [(5, 7, 4), (1, 1, 1), (30, 2, 20), (3, 40, 43), (0, 5, 2), (8, 0, 3), (50, 60, 37)])
def test_hypergeometric_law(good, bad, drawn):
    steps = 40_000
    seen = Counter(sh.hypergeometric(good, bad, drawn, (i + 0.5) / steps) for i in range(steps))
    for k in range(drawn + 1):
        wanted = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) if k <= good and drawn - k <= bad else 0
        assert abs(seen[k] / steps - wanted) < 2 / steps


def test_hypergeometric_of_large_counts():
    good, bad, drawn = 25 * 10**9, 975 * 10**9, 5 * 10**11
    u = np.linspace(0.0005, 0.9995, 400)
    found = np.array([sh.hypergeometric(good, bad, drawn, x) for x in u])
    mean, spread = drawn * good / (good + bad), (drawn * 0.025 * 0.975 * 0.5) ** 0.5
    assert abs(found.mean() - mean) < spread / 50 and 0.97 < found.std() / spread < 1.02


def test_matrix_sums_and_law():
    counts, sizes = [3, 0, 5, 1, 2], sh.shard_sizes(11, 4)
    assert sizes.tolist() == [3, 3, 3, 2]
    seen = Counter()
    for seed in range(3000):
        matrix = sh.CommunicationMatrix(counts, sizes, seed)
        rows = [matrix.row(p) for p in range(len(counts))]
        sent = np.array([r[0] for r in rows])
        assert (sent >= 0).all() and sent.sum(1).tolist() == counts and (sent.sum(0) == sizes).all()
        assert all((rows[p][1] == sent[:p].sum(0)).all() for p in range(len(counts)))
        again = sh.CommunicationMatrix(counts, sizes, seed)
        assert (again.row(2)[0] == sent[2]).all()
        seen[tuple(sent[0].tolist())] += 1
    for row in product(range(4), repeat=4):
        if sum(row) == 3:
            wanted = np.prod([comb(int(m), k) for m, k in zip(sizes, row, strict=True)]) / comb(11, 3)
            assert abs(seen[row] / 3000 - wanted) < 5 * (max(wanted, 1e-3) / 3000) ** 0.5


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 65, 1000, 4097])
def test_permutation(size):
    at = np.arange(size)
    assert sorted(sh.permuted(at, np.uint64(size), np.uint64(99)).tolist()) == list(range(size))
    far = sh.permuted(np.array([0, 5, 10**12 - 1]), np.uint64(10**12), np.uint64(7))
    assert len(set(far.tolist())) == 3 and far.max() < 10**12


def test_places_are_uniform():
    counts, sizes = [4, 1, 3], sh.shard_sizes(8, 3)
    names, seen = np.arange(3), Counter()
    p, pos = np.array([0, 0, 0, 0, 1, 2, 2, 2]), np.array([0, 1, 2, 3, 0, 0, 1, 2])
    trials = 6000
    for seed in range(trials):
        shard, slot = sh._place(sh.CommunicationMatrix(counts, sizes, seed), names, p, pos)
        place = list(zip(shard.tolist(), slot.tolist(), strict=True))
        assert len(set(place)) == 8
        seen.update(enumerate(place))
        seen[place[0], place[5]] += 1
    for key, n in seen.items():
        wanted = trials / 8 if isinstance(key[0], int) else trials / 56
        assert abs(n - wanted) < 5 * wanted**0.5, key


def test_rows_of_all_kinds(spark):
    rows = [(i, f"t{i}", 1, 2, 3) for i in range(50)] + [(7, "same", 0, 0, 0)] * 40 + [(None, None, None, None, None)] * 5 + [(99, "x" * 500_000, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot int, row int").repartition(5)
    got = sh.shard_documents(docs, 7).collect()
    check(got, 7)
    assert sorted(map(repr, (tuple(r.row) for r in got))) == sorted(map(repr, rows))
    same = Counter(r.shard for r in got if r.row.text == "same")
    assert len(same) == 7 and max(same.values()) < 20
    few = sh.shard_documents(docs.limit(3), 7).collect()
    assert len(few) == 3 and [r.slot for r in few] == [0, 0, 0] and {r.shard for r in few} == {0, 1, 2}
    assert sh.shard_documents(docs.limit(0), 7).count() == 0


def test_query(spark):
    from tidewatch.llm.queries import op11_sharding

    folder = "/root/testdata/sf0.001"
    rows = op11_sharding(spark, folder).collect()
    check(rows, 40)
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]), "rows", None)
    assert {(r.doc_id, r.shard, r.slot) for r in op11_sharding(spark, folder).collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
