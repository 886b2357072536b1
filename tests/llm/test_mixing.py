from __future__ import annotations

import numpy as np
import pytest

from tidewatch.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, copies long, row string, key string"


def test_targets():
    got = mixing.targets([("b", 100), (None, 50), ("a", 10)], weights=(3, 1, 2), share=1.5, most=2.0)
    # a: weight 3, at most 20; the rest of 240 goes to b (1) and null (2): 73.3 and 146.7, null at most 100.
    assert got == {"a": 20.0, None: 100.0, "b": pytest.approx(120.0)}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    for size in (rng.integers(0, 500, 400).astype(float), np.full(50, 7.0), np.zeros(30)):
        p = rng.uniform(0, 1, len(size))
        out = mixing.flight(p, size, rng.uniform(size=len(size)))
        assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
        assert out.sum() == pytest.approx(p.sum(), abs=1e-4) and (out * size).sum() == pytest.approx((p * size).sum(), abs=1e-2)
        landed = mixing.land(out, size)
        assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= size.max() + 1e-6


def test_flight_is_unbiased():
    size, p = np.array([3.0, 5.0, 8.0, 13.0, 21.0]), np.array([0.2, 0.7, 0.5, 0.4, 0.6])
    rng = np.random.default_rng(6)
    mean = np.mean([mixing.flight(p, size, rng.uniform(size=5)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix(spark, babble):
    rows = [(i, babble(i, 1 + i % 40), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    rows += [(1000, None, "s1"), (1001, "", "s1"), (1002, "one", None), (1002, "one", None), (None, "two words", "s2"), (1003, "\t", "blank")]
    table = spark.createDataFrame([(*r, 7, 8, "x", "y") for r in rows], SCHEMA)
    mixed = mixing.mix_sources(table, block=40)
    got = mixed.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(table, block=40).collect()))
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = mixing.targets(list(sizes.items()))
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.target == pytest.approx(wanted[source]) and r.source_size == sizes[source] for r in own)
        taken = sum(r.copies * r["size"] for r in own)
        assert abs(taken - wanted[source]) <= max(r["size"] for r in own) and all(0 <= r.copies <= 2 for r in own)
    # The mixed rows are those of the table, as often as counted, with its columns.
    out = mixing.repeated(table)
    assert out.columns == table.columns
    texts = {(r.doc_id, r.text) for r in table.collect()}
    copies = {}
    for r in mixing.mix_sources(table).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    seen: dict = {}
    for r in out.collect():
        assert (r.doc_id, r.text) in texts and r["size"] == 7
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: c for d, c in copies.items() if c}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0 and mixing.repeated(empty).count() == 0
