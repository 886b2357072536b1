"""Conversation repair against an exhaustive table of prefixes and against plain counts."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import pytest
from check_oracles import compare, open_tables

from tidewatch.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(codes):
    """The least (cost, audit) over all edits, insertions before, between and after rows included."""
    best = {"": (0, "")}  # role initials given so far, as far as they matter: last one, and whether any

    def legal(last, c):
        return (c == "u" and last in ("", "s", "a")) or (c == "a" and last == "u") or (c == "s" and last == "")

    def insert(best):
        for _ in range(4):
            for last, (cost, audit) in list(best.items()):
                for c in "ua":
                    if legal(last, c):
                        best[c] = min(best.get(c, (10**9, "")), (cost + 5, audit + "I"))
        return best

    best = insert(best)
    for code in codes:
        after = {}

        def put(last, cost, audit, after=after):
            after[last] = min(after.get(last, (10**9, "")), (cost, audit))

        for last, (cost, audit) in best.items():
            put(last, cost + 2, audit + "D")
            if code != "x":
                more = 5 if code.isupper() else 0
                for c in "sua":
                    if code.lower() == c and legal(last, c):
                        put(c, cost + more, audit + "K")
                    if c != "s" and legal(last, c):
                        put(c, cost + 1 + more, audit + "R")
        best = insert(after)
    return min(best[k] for k in ("", "a") if k in best)


def solved(codes, size):
    cuts = [codes[i : i + size] for i in range(0, len(codes), size)]
    tables = []
    for k, part in enumerate(cuts):
        begins = (0,) if k == 0 else range(4)
        tables.append({(b, e): r for b in begins for e in range(4) if (r := cv.repair(part, b, e)) is not None})
    return cv.join_segments(tables)


def test_all_short_conversations():
    for n in range(5):
        for codes in map("".join, product("suaoxSUA", repeat=n)):
            wanted = cheapest(codes)
            assert solved(codes, 100) == wanted, codes
            assert solved(codes, 2) == wanted, codes


def test_long_conversations():
    rng = random.Random(1)
    for size in (1, 3, 7, 64, 512):
        for _ in range(6):
            codes = "".join(rng.choice("suuuaaaoxxSUAO") for _ in range(rng.randrange(30, 400)))
            assert solved(codes, size) == cheapest(codes), codes
    codes = "ua" * 3000
    assert solved(codes, 512) == (0, "K" * 6000)


def test_bounds_are_never_above_the_cost():
    rng = random.Random(2)
    for _ in range(200):
        codes = "".join(rng.choice("suaoxSUA") for _ in range(rng.randrange(1, 9)))
        for begin, end in product(range(4), range(4)):
            found = cv.repair(codes, begin, end)
            assert found is None or cv.suffix_bounds(codes, end)[0][begin] <= found[0]


def by_definition(rows):
    """The summary of one conversation's rows (turn, role, text), and its repaired turns."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, codes, faults = set(), "", []
    for _, role, text in rows:
        kept = text.rstrip(cv.BLANKS)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = cheapest(codes)
    told, at, last = [], 0, ""
    for letter in audit:
        role, text = (rows[at][1], rows[at][2]) if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        told.append((role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in told))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), told


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "é.", "line one.\nline two", "Yes. \t"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in (1, 2, 3, None) for _ in range(14)]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(900)]  # cut over partitions
    rows += [(5, 1, "user", "again.")] * 700 + [(6, 0, "user", "x" * 400_000 + "."), (6, 1, "assistant", "Yes.")]
    rows += [(7, None, "assistant", "One."), (7, None, "assistant", "One."), (8, 3, None, None)]
    return rows


@pytest.mark.parametrize("segment", [512, 40])
def test_against_the_definition(spark, odd_rows, segment):
    table = spark.createDataFrame([(*r, 1, 2, "p", "m") for r in odd_rows], SCHEMA + ", n long, seq long, part string, mark string")
    plans = cv.plan_repairs(table, segment=segment).cache()
    got = {r.conv_id: r for r in plans.collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    turns = {}
    for r in cv.repaired_turns(table, plans).collect():
        turns.setdefault(r.conv_id, []).append((r.slot, r.edit, r.role, r.text))
    digests = {r.conv_id: r.digest for r in cv.repaired_digests(table, plans).collect()}
    assert len(got) == len({r[0] for r in odd_rows}) == len(digests)
    for conv in got:
        wanted, told = by_definition([r[1:] for r in odd_rows if r[0] == conv])
        assert tuple(got[conv][c] for c in names) == wanted, conv
        found = sorted(turns.get(conv, []))
        assert [t[0] for t in found] == list(range(len(told))) and [(t[2], t[3]) for t in found] == told
        assert [t[1] for t in found] == [c for c in got[conv].audit if c != "D"]
        assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    plans = cv.plan_repairs(empty)
    assert plans.count() == 0 and cv.repaired_turns(empty, plans).count() == 0 and cv.repaired_digests(empty, plans).count() == 0


def test_query_on_odd_rows(spark, odd_rows, tmp_path):
    spark.createDataFrame([r for r in odd_rows if r[0] != 5], SCHEMA).write.parquet(f"{tmp_path}/many")
    spark.read.parquet(f"{tmp_path}/many").coalesce(1).write.parquet(f"{tmp_path}/one")
    import glob
    import shutil

    (part,) = glob.glob(f"{tmp_path}/one/part-*.parquet")
    shutil.copy(part, f"{tmp_path}/conversations.parquet")
    assert compare(spark, open_tables(str(tmp_path)), str(tmp_path), "op12_conversation_repair") == ""
