"""Repairing conversations by depth-first branch and bound.

A conversation's rows are kept, reroled, deleted, or joined by inserted turns, so that roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant in turn. The search walks the rows
with an explicit stack. A node is a row and the last role given; its children are the edits possible
there. A prefix is cut off if a lower bound of what the remaining rows cost shows that it cannot beat
the incumbent (cost, audit), or if the dominance table holds a better prefix of the same node.

Long conversations are cut into segments of bounded length. A segment is solved for every role it
may begin after and end with, all over the cluster, and the best chain of segments is put together
from these few results. Rows travel without their texts until the edits are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.llm.common import pieces

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SEGMENT = 512
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role given
BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

# A row's code: the initial of its role (o for any but s, u, a), a capital where its text is
# truncated, x where it must go.
_AFTER = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,), "s": (START,), "o": ()}
_GIVES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _edits(code: str | None, last: int) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows used, role given) of the edits possible at a row, or at the end if ``code`` is None."""
    turn = ASSISTANT if last == USER else USER
    yield "I", INSERT, 0, turn
    if code is None:
        return
    yield "D", DELETE, 1, last
    if code == "x":
        return
    initial, extra = code.lower(), TRUNCATED if code.isupper() else 0
    keeps = last in _AFTER[initial]
    if keeps:
        yield "K", extra, 1, _GIVES[initial]
    if not (keeps and _GIVES[initial] == turn):  # else keeping does the same for less
        yield "R", REROLE + extra, 1, turn


def suffix_bounds(codes: str, end: int) -> list[list[int]]:
    """For each row and last role, a lower bound of the cost from there to ``end``.

    On the way to an assistant turn it lets a system turn pass for one, so it is below the true cost
    where a repair would then end on its system turn.
    """
    merged = end == ASSISTANT

    def settled(row: list[int]) -> list[int]:
        if merged:
            row[SYSTEM] = row[ASSISTANT] = min(row[SYSTEM], row[ASSISTANT])
        for _ in range(2):
            row = [min(row[last], INSERT + row[ASSISTANT if last == USER else USER]) for last in range(4)]
        return row

    bounds = [settled([0 if last == end else _FAR for last in range(4)])]
    for code in reversed(codes):
        after = bounds[-1]
        bounds.append(settled([min(cost + after[to] for _, cost, used, to in _edits(code, last) if used) for last in range(4)]))
    return bounds[::-1]


@lru_cache(maxsize=8192)
def repair(codes: str, begin: int, end: int) -> tuple[int, str] | None:
    """The least (cost, audit) of edits of ``codes`` after role ``begin`` that end on role ``end``; None if there are none."""
    if end in (START, SYSTEM) and begin not in (START, end):
        return None
    bounds = suffix_bounds(codes, end)
    n, best = len(codes), None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, begin)]
    while stack:
        cost, audit, i, last = stack.pop()
        bound = cost + bounds[i][last]
        if bound >= _FAR or (best and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)])):
            continue
        seen = table.get((i, last))
        if seen is not None and seen <= (cost, audit):
            continue
        table[i, last] = (cost, audit)
        if i == n and last == end and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [
            (cost + more, audit + letter, i + used, gives) for letter, more, used, gives in _edits(codes[i] if i < n else None, last)
        ]
        # The most promising child comes off the stack first, the ASCII-least of equal ones.
        children.sort(key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True)
        stack += children
    return best


class _Chain:
    """The audits of joined segments, from the last one back."""

    __slots__ = ("before", "part")

    def __init__(self, before: _Chain | None, part: str):
        self.before, self.part = before, part

    def text(self, stop: _Chain | None = None) -> str:
        parts, at = [], self
        while at is not stop:
            parts.append(at.part)
            at = at.before
        return "".join(reversed(parts))

    def __lt__(self, other: _Chain) -> bool:
        a, b = self.before, other.before
        while a is not b:  # chains of equal length: back to where they part
            a, b = a.before, b.before
        return self.text(a) < other.text(a)


def join_segments(segments: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """The least (cost, audit) through all segments, which ends with nothing or an assistant turn."""
    best: dict[int, tuple[int, _Chain | None]] = {START: (0, None)}
    for solved in segments:
        after: dict[int, tuple[int, _Chain]] = {}
        for (begin, end), (cost, audit) in solved.items():
            if begin in best:
                found = (best[begin][0] + cost, _Chain(best[begin][1], audit))
                if end not in after or found < after[end]:
                    after[end] = found
        best = after
    cost, chain = min(best[s] for s in (START, ASSISTANT) if s in best)
    return cost, chain.text() if chain else ""


# --- rows ---

_SEGMENT = (
    "part int, seq long, first_turn {turn}, last_turn {turn}, n_turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_role string, last_role string, begins array<int>, ends array<int>, costs array<long>, audits array<string>"
)
_LEGAL = {"su", "ua", "au"}


class _Segment:
    def __init__(self, conv, seq: int, begins: range | tuple):
        self.conv, self.seq, self.begins = conv, seq, begins
        self.codes: list[str] = []
        self.roles: list[str] = []
        self.turns: list = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, initial: str, fault: str) -> None:
        self.codes.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial)
        self.roles.append(initial)
        if fault:
            self.counts[fault] += 1
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def row(self, part: int) -> dict:
        codes = "".join(self.codes)
        solved = [(b, e, r) for b in self.begins for e in range(4) if (r := repair(codes, b, e)) is not None]
        return {
            "conv_id": self.conv, "part": part, "seq": self.seq, "first_turn": self.turns[0] if self.turns else None,
            "last_turn": self.turns[-1] if self.turns else None, "n_turns": len(self.turns), **self.counts,
            "illegal": sum(a + b not in _LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False)),
            "first_role": self.roles[0] if self.roles else None, "last_role": self.roles[-1] if self.roles else None,
            "begins": [s[0] for s in solved], "ends": [s[1] for s in solved],
            "costs": [s[2][0] for s in solved], "audits": [s[2][1] for s in solved],
        }


def _described(rows: DataFrame, present: Column) -> DataFrame:
    """Rows without their texts: order key, initial, first fault but for repeats; alike ones together as ``n``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    initial = F.when(F.left(role, F.lit(1)).isin("s", "u", "a"), F.left(role, F.lit(1))).otherwise("o")
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return rows.select(
        "conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("mark"), initial.alias("initial"),
        fault.alias("fault"), text.alias("text"), present.alias("present"),
    )


def _ordered(described: DataFrame) -> DataFrame:
    """Distinct rows of every conversation in order, with the turn that first has their role and text."""
    key = ("conv_id", "turn", "role", "mark", "initial", "fault")
    alike = described.groupBy(*key).agg(F.sum(F.col("present").cast("long")).alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = described.where("present and fault <> 'blank'").groupBy("conv_id", "role", "mark").agg(F.min(order).alias("first"))
    a, b = alike.alias("a"), firsts.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.mark") == F.col("b.mark"))
    later = F.coalesce(F.struct(F.col("a.turn").isNotNull().alias("some"), F.col("a.turn").alias("turn")) > F.col("b.first"), F.lit(False))
    joined = a.join(b, same, "left").select("a.*", later.alias("later"))
    return joined.repartitionByRange("conv_id", "turn", "role", "mark").sortWithinPartitions("conv_id", "turn", "role", "mark")


def _segments(ordered: DataFrame, most: int) -> DataFrame:
    conv, turn = (ordered.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    schema = f"conv_id {conv}, " + _SEGMENT.format(turn=turn)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out = TaskContext.get().partitionId(), None, []
        columns = ("conv_id", "turn", "initial", "fault", "n", "later")
        for batch in batches:
            for name, turn, initial, fault, n, later in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if now is None or name != now.conv:
                    # Only the first conversation of a partition may have begun in an earlier one.
                    fresh = _Segment(name, 0, range(4) if now is None else (START,))
                    if now is not None:
                        out.append(now.row(part))
                    now = fresh
                for copy in range(n):
                    if len(now.codes) >= most:
                        out.append(now.row(part))
                        now = _Segment(name, now.seq + 1, range(4))
                    now.add(turn, initial, "duplicate" if fault != "blank" and (later or copy) else fault)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out = []
        if now is not None:
            out.append(now.row(part))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return ordered.mapInArrow(work, schema)


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(conv, segments: list[dict]) -> dict:
    """A conversation's counts and edits from its segments in order."""
    segments = sorted(segments, key=lambda s: (s["part"], s["seq"]))
    out = {"conv_id": conv} | {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")}
    turns = [s for s in segments if s["n_turns"]]
    distinct = sum(s["n_turns"] for s in turns) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turns, turns[1:], strict=False))
    out["gaps"] = turns[-1]["last_turn"] - turns[0]["first_turn"] + 1 - distinct if turns else 0
    told = [s for s in segments if s["first_role"] is not None]
    out["illegal"] += sum(a["last_role"] + b["first_role"] not in _LEGAL for a, b in zip(told, told[1:], strict=False))
    tables = [
        {(b, e): (c, a) for b, e, c, a in zip(s["begins"], s["ends"], s["costs"], s["audits"], strict=True)} for s in told
    ]
    out["cost"], out["audit"] = join_segments(tables)
    return out


def plan_repairs(rows: DataFrame, present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.

    ``rows`` has conv_id, turn (a whole number), role and text; further columns are ignored. Rows
    follow each other by turn, nulls first, then role and MD5 of the text. A null role or text reads as
    one space, a null conv_id is a conversation of its own. Where ``present`` is false the row only makes its
    conversation known; one without other rows has zeros and an empty audit. An empty table gives
    no rows. A conversation's audit, one letter an edit, is one value and must fit in a task.
    """
    described = _described(rows, F.lit(True) if present is None else F.coalesce(present, F.lit(False)))
    parts = _segments(_ordered(described), segment)
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, {_SUMMARY}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                pairs = zip(some.column("conv_id").to_pylist(), some.column("segments").to_pylist(), strict=True)
                yield pa.RecordBatch.from_pylist([_summary(*pair) for pair in pairs], schema=target)

    names = [c for c in parts.columns if c != "conv_id"]
    return parts.groupBy("conv_id").agg(F.collect_list(F.struct(*names)).alias("segments")).mapInArrow(join, schema)


class _Mender:
    """Applies a conversation's audit to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.slot = audit, 0, START, 0

    def _out(self, letter: str, role: str | None, text: str) -> tuple[int, str, str, str]:
        kept = _GIVES.get((role or "")[:1])
        self.last = kept if letter == "K" else ASSISTANT if self.last == USER else USER
        named = role if letter == "K" else ("user", "assistant")[self.last == ASSISTANT]
        self.slot += 1
        return self.slot - 1, letter, named, text

    def inserts(self) -> Iterator[tuple[int, str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._out("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._out(letter, role, text)


def _followed(rows: DataFrame, plans: DataFrame, present: Column | None) -> DataFrame:
    """Every conversation's audit, then its rows in order, next to each other in a partition."""
    described = _described(rows, F.lit(True) if present is None else F.coalesce(present, F.lit(False))).where("present")
    turn = rows.schema["turn"].dataType
    none = F.lit(None)
    heads = plans.select(
        "conv_id", F.lit(0).alias("kind"), none.cast(turn).alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("mark"), F.col("audit").alias("text"),
    )
    tails = described.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "mark", "text")
    return heads.union(tails).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")


def repaired_turns(rows: DataFrame, plans: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, slot, edit, role, text): the turns of the repaired conversations, by ``plan_repairs`` of the same rows."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, slot long, edit string, role string, text string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender, conv = _Mender(""), None
        for batch in pieces(batches, "text"):
            out = []
            for name, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    out += [(conv, *x) for x in mender.inserts()]
                    mender, conv = _Mender(text), name
                else:
                    out += [(conv, *x) for x in mender.row(role, text)]
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, x, strict=True)) for x in out], schema=target)
        out = [(conv, *x) for x in mender.inserts()]
        yield pa.RecordBatch.from_pylist([dict(zip(target.names, x, strict=True)) for x in out], schema=target)

    return _followed(rows, plans, present).mapInArrow(work, schema)


def repaired_digests(rows: DataFrame, plans: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, digest): SHA-256 of the repaired turns as ``role:text``, joined by line feeds.

    A digest runs over one conversation's text in order, so a conversation's rows pass through one
    task, in a stream of which only the running digest and the audit are held.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, digest string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender, digest, begun, conv = _Mender(""), hashlib.sha256(), False, None

        def told(turns: Iterator[tuple[int, str, str, str]]) -> None:
            for slot, _, role, text in turns:
                digest.update(f"{chr(10) if slot else ''}{role}:{text}".encode())

        for batch in pieces(batches, "text"):
            out = []
            for name, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    told(mender.inserts())
                    if begun:
                        out.append({"conv_id": conv, "digest": digest.hexdigest()})
                    mender, digest, begun, conv = _Mender(text), hashlib.sha256(), True, name
                else:
                    told(mender.row(role, text))
            yield pa.RecordBatch.from_pylist(out, schema=target)
        told(mender.inserts())
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "digest": digest.hexdigest()}] if begun else [], schema=target)

    return _followed(rows, plans, present).mapInArrow(work, schema)
