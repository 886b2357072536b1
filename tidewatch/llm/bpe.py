"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

A byte string has exactly one token sequence in which every two neighbours stay apart when
merged on their own, and that sequence is the BPE encoding; each of its prefixes encodes a prefix
of the bytes. So reading left to right it is enough to know, for every start at which a token may
still be under way, the encoding up to there. Those starts reach back no further than the longest
token, which makes the set of them, with the tokens not yet certain, a state of a finite
transducer. Tokens that all starts agree on are emitted. States and transitions are made when
first met and kept. In a word of up to SHORT bytes the lookahead may run to the end of the word:
there the longest start stands for all, and its transitions alone are determinised.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidewatch.llm.common import pieces

# Bounds on what a worker keeps; beyond them it starts anew, with the same results. Words count by
# the bytes they take, some 300 each; a transition takes about 400 with its state, a pair 130.
KEPT_BYTES, KEPT_TRANSITIONS, KEPT_PAIRS = 240_000_000, 60_000, 300_000
SHORT = 64  # bytes of a word whose end is awaited
_NEVER = 1 << 40
_LEAF: dict[int, int] = {}
STEP = 50_000  # ids decoded at a time


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the neighbours of least rank, leftmost first, until none has a rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes the bytes of one word of the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]  # of each trie node by byte; the root is 0
        self.ends: list[int] = [-1]  # token that ends at a node
        for token, i in ranks.items():
            node = 0
            for b in token:
                below = self.child[node].get(b)
                if below is None:
                    below = len(self.ends)
                    if not self.child[node]:
                        self.child[node] = {}
                    self.child[node][b] = below
                    self.child.append(_LEAF)
                    self.ends.append(-1)
                node = below
            self.ends[node] = i
        # Of each node the node of its longest proper suffix, and the tokens that end there, longest first.
        self.fail = [0] * len(self.ends)
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(self.ends)
        level, depth = [0], 0
        while level:
            below, depth = [], depth + 1
            for node in level:
                for byte, target in self.child[node].items():
                    at = self.fail[node]
                    while at and byte not in self.child[at]:
                        at = self.fail[at]
                    if node:
                        self.fail[target] = self.child[at].get(byte, 0)
                    own = ((depth, self.ends[target]),) if self.ends[target] >= 0 else ()
                    self.suffixes[target] = own + self.suffixes[self.fail[target]]
                    below.append(target)
            level = below
        self.follow: list[dict[int, int] | None] = [None] * len(self.ends)
        self.followed = 0
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple | None] = {-1: ()}
        self._forget()

    def _forget(self) -> None:
        # A state: positions after the last certain one, each (earlier position, token), the first
        # being that certain one; and the starts under way, each (position, trie node).
        start = (((-1, -1),), ((0, 0),))
        self.states: list[tuple] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}

    def _history(self, token: int) -> tuple | None:
        """How a token forms on its own: ranks of the joins in order, and its outer parts before each
        and after the last. None where it does not come out whole."""
        data = self.tokens[token]
        parts, joins, left, right = [data[i : i + 1] for i in range(len(data))], [], [data[:1]], [data[-1:]]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            joins.append(rank)
            left.append(parts[0])
            right.append(parts[-1])
        return (*joins, _NEVER), left, right

    def _apart(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing) in an encoding: no join crosses them.

        Each side forms as it would alone; a join across them happens when its rank comes first.
        """
        key = (left + 1) << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        for token in (left, right):
            if token not in self.histories:
                self.histories[token] = self._history(token)
        a, b = self.histories[left], self.histories[right]
        self.pairs[key] = known = a is not None and b is not None and (left < 0 or self._never_cross(a, b))
        return known

    def _never_cross(self, a: tuple, b: tuple) -> bool:
        i = j = 0
        while True:
            of_a, of_b = a[0][i], b[0][j]
            across = self.ranks.get(a[2][i] + b[1][j], _NEVER)
            if across < of_a and across <= of_b and across < _NEVER:
                return False
            if of_a == of_b == _NEVER:
                return True
            if of_a <= of_b:
                i += 1
            else:
                j += 1

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        spots, starts = self.states[number]
        child, ends, under_way, added = self.child, self.ends, [], None
        for spot, node in starts:
            node = child[node].get(byte)
            if node:
                under_way.append((spot, node))
                if added is None and ends[node] >= 0 and self._apart(spots[spot][1], ends[node]):
                    added = (spot, ends[node])
        if added is None:
            raise ValueError("the vocabulary lacks a single byte")
        spots += (added,)
        last = len(spots) - 1
        under_way.append((last, 0))
        # As bits: the positions that a position rests on, those any start needs, those all share.
        rests = [1]
        for k in range(1, last + 1):
            rests.append(rests[spots[k][0]] | 1 << k)
        shared = used = rests[last]
        for spot, _ in under_way:
            shared &= rests[spot]
            used |= rests[spot]
        root, out = shared.bit_length() - 1, ()
        if root or used != (1 << last + 1) - 1:
            spot = root
            while spot:
                out = (spots[spot][1], *out)
                spot = spots[spot][0]
            kept = [k for k in range(root, last + 1) if used >> k & 1]
            place = {k: i for i, k in enumerate(kept)}
            spots = ((-1, spots[root][1]), *((place[spots[k][0]], spots[k][1]) for k in kept[1:]))
            under_way = [(place[k], node) for k, node in under_way]
        state = (spots, tuple(under_way))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        self.moves[number * 256 + byte] = move = (target, out)
        return move

    def _rest(self, number: int) -> tuple[int, ...]:
        """The tokens still held back when the word ends."""
        spots, out = self.states[number][0], []
        spot = len(spots) - 1
        while spots[spot][0] >= 0:
            out.append(spots[spot][1])
            spot = spots[spot][0]
        self.finals[number] = rest = tuple(reversed(out))
        return rest

    def _follow(self, node: int, byte: int) -> int:
        """The trie node of the longest suffix that is under way after one more byte; kept."""
        at = node
        while at and byte not in self.child[at]:
            at = self.fail[at]
        target = self.child[at].get(byte, 0)
        if self.followed > KEPT_TRANSITIONS:
            self.follow = [None] * len(self.ends)
            self.followed = 0
        if self.follow[node] is None:
            self.follow[node] = {}
        self.follow[node][byte] = target
        self.followed += 1
        return target

    def _short(self, data: bytes) -> tuple[int, ...]:
        """The tokens of a short word: the last token of every prefix, then back along them.

        All starts under way are suffixes of the longest one, so its trie node stands for them, and
        the word's end for the end of the lookahead.
        """
        node, lasts, sizes, follow, suffixes, pairs = 0, [-1], [0], self.follow, self.suffixes, self.pairs
        for at, byte in enumerate(data):
            known = follow[node]
            target = known.get(byte) if known is not None else None
            if target is None:
                target = self._follow(node, byte)
                follow = self.follow
            node = target
            for size, token in suffixes[node]:
                left = lasts[at + 1 - size]
                apart = pairs.get((left + 1) << 32 | token)
                if self._apart(left, token) if apart is None else apart:
                    lasts.append(token)
                    sizes.append(size)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        out, at = [], len(data)
        while at:
            out.append(lasts[at])
            at -= sizes[at]
        return tuple(reversed(out))

    def word(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) <= SHORT:
            return self._short(data)
        if len(self.moves) > KEPT_TRANSITIONS:
            self._forget()
        number, out, moves = 0, [], self.moves
        for byte in data:
            move = moves.get(number * 256 + byte) or self._move(number, byte)
            number = move[0]
            if move[1]:
                out += move[1]
            if len(moves) > 2 * KEPT_TRANSITIONS:  # within one very long word
                state = self.states[number]
                self._forget()
                moves = self.moves
                number = self.numbers.setdefault(state, len(self.states))
                if number == len(self.states):
                    self.states.append(state)
        rest = self.finals.get(number)
        return (*out, *(rest if rest is not None else self._rest(number)))


class Encoder:
    """Splits text by a pattern and encodes each match.

    With the usual pattern of byte-level vocabularies, a blank goes with the word behind it. There a
    single space or line feed between two visible characters begins a new match, so what lies
    between such places is looked up whole; anything else is split by the pattern itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, blanks_lead: bool = True, kept_bytes: int = KEPT_BYTES):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.blanks_lead = blanks_lead
        self.kept_bytes = kept_bytes
        # Ids are kept as packed numbers, which join faster and take less room than tuples.
        self.code = "H" if max(ranks.values(), default=0) < 1 << 16 else "I"
        # Words by what leads them; of each the words met lately and those met in the time before.
        self.matches: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.earlier: tuple[dict, dict, dict] = ({}, {}, {})
        self.kept = 0
        self.feed = self._split("\n")

    def _keep(self, known: dict, text: str, ids: bytes) -> None:
        """Remember a word of usual length. When half the room is taken, the words met lately become the
        earlier ones, of which those met again come back, and the others are forgotten the next time."""
        if len(text) > 48:
            return
        if self.kept > self.kept_bytes // 2:
            self.earlier = tuple(dict(words) for words in (self.matches, self.after_blank, self.first))
            for words in (self.matches, self.after_blank, self.first):
                words.clear()
            self.kept = 0
        known[text] = ids
        # A dictionary's slots, a text of up to two bytes a character, and the packed ids.
        self.kept += 100 + 74 + 2 * len(text) + 40 + len(ids)

    def _match(self, text: str, keep: bool = True) -> bytes:
        ids = self.matches.get(text)
        if ids is None and text[0] == " ":  # kept as a word behind a blank
            ids = self.after_blank.get(text[1:])
        if ids is None:
            ids = self.earlier[0].get(text)
            if ids is None:
                ids = array(self.code, self.machine.word(text.encode("utf-8", "surrogatepass"))).tobytes()
            if keep:
                self._keep(self.matches, text, ids)
        return ids

    def _split(self, text: str) -> bytes:
        found = [m.group() for m in self.pattern.finditer(text)]
        if len(found) == 1:  # kept by the caller, with what led it
            return self._match(found[0], False)
        return b"".join(map(self._match, found))

    def _looked_up(self, known: dict, chunk: str, lead: str) -> bytes:
        ids = known.get(chunk)
        if ids is None:
            ids = self.earlier[1 if lead else 2].get(chunk)
            if ids is None:
                ids = self._split(lead + chunk)
            self._keep(known, chunk, ids)
        return ids

    def _line(self, line: str) -> bytes:
        chunks = line.split(" ")
        known = self.after_blank
        ids = list(map(known.get, chunks))
        if None in ids or chunks[0] not in self.first:
            if any(not c or c[0].isspace() or c[-1].isspace() for c in chunks):
                return self._split(line)
            ids[0] = b""
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = self._looked_up(known, chunks[i], " ")
        ids[0] = self._looked_up(self.first, chunks[0], "")
        return b"".join(ids)

    def packed(self, text: str | None) -> np.ndarray:
        """The ids of a text as an array of unsigned numbers."""
        if not text:
            return np.empty(0, dtype=self.code)
        if not self.blanks_lead:
            return np.frombuffer(self._split(text), dtype=self.code)
        return np.frombuffer(self.feed.join(map(self._line, _LINE_END.split(text))), dtype=self.code)

    def encode(self, text: str | None) -> list[int]:
        return self.packed(text).tolist()


# A line feed between visible characters.
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")

# Continuation ranges after a first byte, fixed by UTF-8: (first, last, ranges of the rest).
_SHAPES = (
    (0xC2, 0xDF, ((0x80, 0xBF),)),
    (0xE0, 0xE0, ((0xA0, 0xBF), (0x80, 0xBF))),
    (0xE1, 0xEC, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xED, 0xED, ((0x80, 0x9F), (0x80, 0xBF))),
    (0xEE, 0xEF, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xF0, 0xF0, ((0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF1, 0xF3, ((0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF4, 0xF4, ((0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))),
)


def open_tail(data: bytes) -> int:
    """Length of the beginning of a character at the end of ``data``: 0 to 3."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead < 0x80 or lead >= 0xC2:
            shape = next((s[2] for s in _SHAPES if s[0] <= lead <= s[1]), ())
            rest = data[len(data) - back + 1 :]
            fits = len(rest) < len(shape) and all(a <= b <= z for b, (a, z) in zip(rest, shape, strict=False))
            return back if fits else 0
    return 0


class StreamDecoder:
    """Turns ids into text as they come; a character split over tokens waits for its last byte.

    Bytes that are no UTF-8 become U+FFFD as in a decoding of the whole.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.waiting = b""

    def push(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        tail = open_tail(data)
        self.waiting = data[len(data) - tail :] if tail else b""
        return data[: len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a tiktoken file: base64 and a number per line."""
    store, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with store.open_input_stream(place) as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.read().splitlines()) }


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    return Encoder(load_ranks(path), pattern, kept_bytes=kept_bytes)


@lru_cache(maxsize=2)
def token_table(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def _decoded(tokens: list[bytes], ids: np.ndarray) -> str:
    machine = StreamDecoder(tokens)
    said = [machine.push(ids[i : i + STEP].tolist()) for i in range(0, len(ids), STEP)]
    return "".join([*said, machine.close()])


def encode_documents(
    docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = False,
    kept_bytes: int = KEPT_BYTES,
) -> DataFrame:
    """The ``keep`` columns and ``ids`` of every row of ``docs`` (text and those columns).

    Null and empty texts have no ids. Every match of ``pattern`` is encoded by itself; there are
    no special tokens. ``path`` is a rank file that every executor can open. Repeated rows are
    encoded each; other columns are not read. With ``decode`` the ids are decoded again, as a stream, in
    the worker that made them, and ``text`` is what they give. A worker remembers words in
    ``kept_bytes``: less room takes more time and gives the same ids.
    """
    chosen = docs.select(*keep, "text")
    schema = StructType([chosen.schema[name] for name in keep]).add("ids", ArrayType(IntegerType()))
    schema = schema.add("text", "string") if decode else schema
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, tokens = encoder(path, pattern, kept_bytes), token_table(path) if decode else []
        for piece in pieces(batches, "text"):
            ids = [engine.packed(t).astype(np.int32) for t in piece.column("text").to_pylist()]
            columns = {name: piece.column(name) for name in keep} | {"ids": ids}
            if decode:
                columns["text"] = [_decoded(tokens, x) for x in ids]
            yield pa.RecordBatch.from_pydict(columns, schema=target)

    return chosen.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its ``ids`` replaced by their ``text``, decoded as a stream; null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = StructType(list(kept)).add("text", "string")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_table(path)
        for batch in batches:
            column = batch.column("ids")
            for first in range(0, batch.num_rows, 64):
                part = column.slice(first, 64)
                texts = []
                for ids in part:
                    if not ids.is_valid:
                        texts.append(None)
                        continue
                    texts.append(_decoded(tokens, ids.values.to_numpy(zero_copy_only=False)))
                columns = {f.name: batch.column(f.name).slice(first, 64) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | {"text": texts}, schema=target)

    return encoded.mapInArrow(run, schema)
