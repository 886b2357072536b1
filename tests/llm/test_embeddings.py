from __future__ import annotations

import numpy as np

from tidewatch.llm import embeddings

from .conftest import least_reachable

SCHEMA = "vec_id long, embedding array<double>, label int, dim string, node string, unit string"


def expected(rows):
    able = {}
    for i, v, label in rows:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0 and label is not None
        if ok:
            x = np.array(v) / np.abs(v).max()
            able[i] = (label, x / np.linalg.norm(x))
    ids, links = list(able), []
    for a in ids:
        for b in ids:
            if a < b and able[a][0] == able[b][0] and len(able[a][1]) == len(able[b][1]) and able[a][1] @ able[b][1] >= 0.98:
                links.append((a, b))
    least = least_reachable([r[0] for r in rows], links)
    return {i: (sum(i in p for p in links), least[i]) for i in least}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 25)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=32).tolist(), i % 3) for i in range(150)]
    center = rng.normal(size=32)
    center /= np.linalg.norm(center)
    for i in range(150):  # a dense group around the threshold
        rows.append((1000 + i, (center + rng.normal(size=32) * 0.12 / np.sqrt(32) * (1 + i % 3)).tolist(), 1))
    rows += [(2000 + i, (np.array(rows[i][1]) * 1e200).tolist(), i % 3) for i in range(4)]
    rows += [(3000, None, 1), (3001, [0.0] * 32, 1), (3002, [None] * 32, 1), (3003, [float("nan")] * 32, 1), (3004, rows[1][1], None)]
    rows += [(3005, [float("inf")] * 32, 1), (3006, [], 1), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (3009, [-0.0, 1.0], 1), (3010, [0.0, 1.0], 1)]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    wanted = expected(rows)
    got = {r.vec_id: r for r in embeddings.linked_vectors(table).collect()}
    assert len(got) == len(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.linked_vectors(table).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, True)]
    assert embeddings.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_count():
    needed = embeddings.collisions_needed(24, 2.0, 0.99999)
    rng = np.random.default_rng(1)
    hits = (np.abs(rng.normal(size=(200_000, 24))) <= 2.0).sum(axis=1) >= needed
    assert hits.mean() > 0.9999 and needed > 12
