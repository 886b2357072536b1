from __future__ import annotations

import random
import re

from tidewatch.llm import line_dedup

SCHEMA = "doc_id long, text string, d long, k long, line string, s string, n_chars long"


def words(line):
    return frozenset(re.findall("[^\\x20\\x09-\\x0D]+", line.translate({c: c + 32 for c in range(65, 91)})))


def removed(rows):
    lines = [(d, i, words(x)) for d, t in sorted(rows, key=lambda r: r[0]) if t is not None for i, x in enumerate(t.split("\n"))]
    gone: dict = {}
    for at, (d, i, s) in enumerate(lines):
        if s and any(100 * len(s & e) >= 75 * len(s | e) for _, _, e in lines[:at] if e):
            gone.setdefault(d, []).append(i)
    return gone


def test_against_all_pairs(spark, babble, edit):
    head = babble(7, 9)
    rows = [(i, f"{head}\n{babble(100 + i, 40)}\n\nThe end {i}") for i in range(30)]
    base = babble(8, 40)
    rows += [(50 + i, edit(base, i, i % 9) + "\n" + base.upper()) for i in range(40)]
    rows += [(100 + i, babble(300 + i, 1 + i % 12)) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " \t"), (204, "same same same"), (205, "same"), (206, "é"), (207, "É")]
    rows += [(208, "Été À Ⅷ Ǆ ΟΔΟΣ İI"), (209, "été à ⅷ ǆ οδος i̇i"), (210, "ÉtÉ à ONE TWO"), (211, "ÉtÉ à one two"), (212, "ÉTé À one two")]
    rows += [(213, " ".join(f"Word{i}" for i in range(30_000))), (214, " ".join(f"word{i}" for i in range(29_000)))]
    table = spark.createDataFrame([(d, t, 1, 2, "x", "y", 5) for d, t in rows], SCHEMA)
    wanted = removed(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table).collect()}
    assert {d: r.removed for d, r in got.items() if r.removed} == wanted
    assert {d: r.n_lines for d, r in got.items()} == {d: 0 if t is None else t.count("\n") + 1 for d, t in rows}
    # The texts: those that had words and keep none go, others keep their other lines.
    repeated = spark.createDataFrame([(0, rows[0][1], 1, 2, "x", "y", 5), (None, head, 1, 2, "x", "y", 5)], SCHEMA)
    out = line_dedup.without_repeated_lines(table.union(repeated)).collect()
    texts = {}
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in wanted.get(d, ()))
        if d not in wanted or words(kept.replace("\n", " ")):
            texts[d] = kept
    assert {r.doc_id: r.text for r in out} == texts
    assert sum(r.doc_id == 0 for r in out) == 2 and all(r.line == "x" for r in out)
    assert all(r.n_chars == (len(r.text) if r.doc_id in wanted else 5) for r in out)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python(spark):
    from tidewatch.llm.queries import op1_url_filter, op3_line_dedup

    for query in (op1_url_filter, op3_line_dedup):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert not re.search("Arrow|Pandas|Python|Cartesian|NestedLoop", plan)


def test_wide_parity_maps_leave_unlike_long_lines_out(spark):
    """Sets of 200 words fill a map of 64 bits, so that unlike ones pass it; no similar pair is lost."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: rng.randrange(-(2**31), 2**31)
    base = [[word() for _ in range(200)] for _ in range(12)]
    sets = [(i, s) for i, s in enumerate(base)] + [(100 + i, s[: 200 - 2 * i] + [word() for _ in range(2 * i)]) for i, s in enumerate(base)]
    classes = spark.createDataFrame([(i, len(s), s) for i, s in sets], "id long, n int, s array<int>")
    ends = [classes.select(F.col("id").alias(e)) for e in "xy"]
    pairs = ends[0].join(ends[1], F.col("x") < F.col("y"))
    kept = {tuple(r) for r in line_dedup._may_reach(pairs, classes, 75).collect()}
    by_id = dict(sets)
    true = {(x, y) for x in by_id for y in by_id if x < y and 100 * len({*by_id[x]} & {*by_id[y]}) >= 75 * len({*by_id[x]} | {*by_id[y]})}
    assert true == {(i, 100 + i) for i in range(12)} and true <= kept and len(kept) < len(true) + 5
    narrow = classes.select("id", line_dedup._parity(F.col("s")).alias("p")).collect()
    passed = [(a.id, b.id) for a in narrow for b in narrow if a.id < b.id and bin((a.p ^ b.p) & (2**64 - 1)).count("1") <= 400 - 2 * 172]
    assert len(passed) > 200


def test_maps_of_all_widths_bound_the_difference(spark):
    """No map tells more words apart than there are, whichever widths meet; unlike lines of 100 words are told apart in the join."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    word = lambda: rng.randrange(-(2**31), 2**31)
    sets = [[word() for _ in range(n)] for n in (3, 40, 41, 45, 100, 101, 110)]
    sets += [s[: len(s) - len(s) // 9] + [word() for _ in range(len(s) // 9 + extra)] for s in sets for extra in (0, 1)]
    sets += [[word() for _ in range(100)] for _ in range(20)]
    maps = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "id long, n int, s array<int>").select("id", "n", *line_dedup._map())
    p, r = maps.alias("p"), maps.alias("r")
    of = lambda e: [F.col(f"{e}.{c}") for c in line_dedup.MAP]
    least = line_dedup._differ(F.col("p.n"), F.col("r.n"), of("p"), of("r"))
    rows = p.join(r, F.col("p.id") < F.col("r.id")).select(F.col("p.id"), F.col("r.id"), least, line_dedup._alike(75)).collect()
    for x, y, bits, alike in rows:
        a, b = set(sets[x]), set(sets[y])
        assert bits <= len(a ^ b)
        assert alike or 100 * len(a & b) < 75 * len(a | b)
    first = len(sets) - 20
    assert not any(alike for x, _, _, alike in rows if x >= first)


def test_join_makes_few_pairs_of_unlike_long_lines(spark, monkeypatch):
    """Lines of 90 words that share rare ones: the join passes on no pair, where maps of 64 bits let many pass."""
    rng = random.Random(3)
    rows = [(i, " ".join([f"r{rng.randrange(60)}" for _ in range(30)] + [f"c{rng.randrange(3000)}" for _ in range(80)])) for i in range(300)]
    seen = []
    whole = line_dedup._similar
    monkeypatch.setattr(line_dedup, "_similar", lambda pairs, *rest: (seen.append(pairs.count()), whole(pairs, *rest))[1])
    table = spark.createDataFrame([(d, t, 1, 2, "x", "y", 5) for d, t in rows], SCHEMA)
    assert line_dedup.repeated_lines(table).count() == 0
    assert sum(seen) < 30


def test_language_stage_judges_small_pieces(monkeypatch):
    """The pipeline's workers hold later stages' words too: a batch of texts is judged a bounded share at a time."""
    import numpy as np
    import pyarrow as pa

    from tidewatch.llm import language

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    held = []
    monkeypatch.setattr(language, "_judged", lambda model, texts: (held.append(sum(map(len, texts))), (None, None, [1.0] * len(texts)))[1])
    empty = np.zeros((1, 2), np.float32)
    model = language.LanguageModel(("a", "b"), empty, empty, np.zeros(0, np.uint64), empty, language.Chain.flat(2))
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 2000] * 200})
    kept = list(language.keep_known_languages(Docs(), model, 0.4)([batch]))
    assert sum(b.num_rows for b in kept) == 200 and sum(held) == 2_000_000
    assert max(held) <= 300_000
