"""Aligning two tokenizers by external spill counting.

Every text is encoded by a byte-level tokenizer A and a piece tokenizer B. Tokens whose byte ranges
overlap are linked, and each link is weighed by how often its pair of ids is linked in the corpus.

1. A task encodes texts in runs of bounded size. A run's (pair, document) records are sorted by
   radix of the B id, B id, A id and document, and stored per radix as Zstandard blobs: a directory
   of distinct pairs with their totals, and the records behind them. A hot pair is one directory
   entry per run.
2. Directories of a radix are merged 64 at a time by a heap over their B blocks, level by level,
   so that no task holds more than 64 directories and one sum, which the vocabularies bound.
3. The last merge runs side-major (by B id), so a B id's highest count is known as its block ends.
4. The counts stream past the records of a bounded number of runs a task and give one contribution
   per run and radix; the contributions of a run are added up into its documents' rows.

Runs are written to the shared folder first, hence texts are encoded once and a lost executor
repeats only its own part of the counting.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.llm.common import pieces, stage

RUN_BYTES = 4_000_000  # UTF-8 bytes of text in a run, or one longer text
BATCH_BYTES = 400_000  # encoded at a time
RADIXES = 64
FAN_IN = 64  # directories a merge reads
RUNS_A_TASK = 1024  # runs whose records of a radix one task weighs
_DOC_BITS, _ID_BITS = 23, 20  # a sorted record is radix and B id, A id, document in 63 bits

_RUN_SCHEMA = (
    "p int, seq int, doc_id {id}, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups array<string>, directories array<binary>, records array<binary>"
)


# --- blobs ---


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers >= 0, each in the least width that holds it, as one Zstandard frame."""
    head, body = [len(arrays)], []
    for values in arrays:
        top = int(values.max()) if len(values) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
        head += [width, len(values)]
        body.append(values.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, dtype="<i8").tobytes() + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for width, size in head.tolist():
        out.append(np.frombuffer(raw, f"<u{width}", size, at).astype(np.int64))
        at += width * size
    return out


def _gaps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=0)


# --- encoding and linking ---


class _Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, byte_of_id: list[bytes]):
        self.bytes = byte_of_id
        self.sizes = np.array([len(b) for b in byte_of_id], dtype=np.int64)


# Fixed value: how byte-level vocabularies split a text into words.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class BytePairs(_Side):
    """A byte-level vocabulary in a tokenizers file; texts get a space in front.

    Where the file's merges are in the order of their ids, and words are split the usual way, ids are
    ranks, and the words are merged by tiktoken, which gives the same ids in a fourth of the time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        byte = _byte_letters()
        names = [self.coder.id_to_token(i) or "" for i in range(self.coder.get_vocab_size())]
        super().__init__([bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names])
        self.ranked = _ranked(json.loads(self.coder.to_str()), self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def _ranked(file: dict, byte_of_id: list[bytes]):
    """A tiktoken encoding of a tokenizers file whose ids are ranks, else None."""
    import tiktoken

    model, split = file["model"], file["pre_tokenizer"] or {}
    added = {t["id"] for t in file["added_tokens"]}
    plain = file["normalizer"] is None and model["type"] == "BPE" and not model.get("ignore_merges")
    usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    joined = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    single = {b for b in byte_of_id[:256] if len(b) == 1}
    if not (plain and usual and len(single) == 256 and joined == list(range(256, 256 + len(joined)))):
        return None
    ranks = {b: i for i, b in enumerate(byte_of_id) if i not in added}
    return tiktoken.Encoding(file["model"]["type"], pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(_Side):
    """A sentencepiece model; it puts the space in front of a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.coder = SentencePieceProcessor(model_file=path)
        n = self.coder.vocab_size()
        single = [self.coder.is_byte(i) for i in range(n)]
        names = [self.coder.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(x[3:5], 16)]) if b else x.replace("▁", " ").encode() for x, b in zip(names, single, strict=True)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def _side(kind: type, path: str) -> _Side:
    return kind(path)


@lru_cache(maxsize=4)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number below ``n`` as decimal bytes in a row, and a mask of the bytes in use, one left for a separator."""
    text = np.array([str(i) for i in range(n)], dtype=f"S{len(str(n)) + 1}")
    return text.view(np.uint8).reshape(n, -1), np.char.str_len(text)


def _group_bytes(ids: np.ndarray, side: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by a separator: ``,``, or ``|`` after the last of A and ``;`` after the last of B.

    Returns the bytes and where each id's bytes end.
    """
    digits, length = _decimals(int(ids.max()) + 1)
    size = length[ids] + 1
    ends = np.cumsum(size)
    out = digits[ids]
    out[np.arange(len(ids)), size - 1] = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(","))
    return out[np.arange(out.shape[1]) < size[:, None]], ends


def align(ids_a: np.ndarray, ids_b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, docs: np.ndarray) -> dict:
    """Groups and links of texts laid end to end; ``end_*`` are where tokens end, ``docs`` where texts end.

    Every stretch between neighbouring ends of either side lies in one token of A and one of B, and
    two tokens that overlap share exactly one stretch: the stretches are the links.
    """
    flags = np.zeros((3, int(docs[-1]) + 1), dtype=bool)
    for flag, ends in zip(flags, (end_a, end_b, docs), strict=True):
        flag[ends] = True
    cuts = np.flatnonzero(flags[0] | flags[1])
    of_a, of_b, of_doc = flags[:, cuts]
    common = of_a & of_b

    def before(flag: np.ndarray) -> np.ndarray:
        """How many flagged ends lie before each cut: the number of the token, group or text it is in."""
        return np.cumsum(flag) - flag

    link_a, link_b = ids_a[before(of_a)], ids_b[before(of_b)]
    doc, group = before(of_doc), before(common)
    group_a, group_b = group[of_a], group[of_b]
    counts = [np.bincount(doc[flag], minlength=len(docs)) for flag in (of_a, of_b, common)]
    counts.append(np.bincount(doc, minlength=len(docs)))
    # The order of the listing: group, side, position. Tokens of B wait for those of A of their group.
    place_a = np.arange(len(ids_a)) + np.cumsum(np.bincount(group_b))[group_a] - np.bincount(group_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(np.bincount(group_a))[group_b]
    n = len(ids_a) + len(ids_b)
    listed, side, last = np.empty(n, np.int64), np.zeros(n, np.int8), np.empty(n, bool)
    listed[place_a], listed[place_b], side[place_b] = ids_a, ids_b, 1
    last[place_a] = np.diff(group_a, append=-1) != 0
    last[place_b] = np.diff(group_b, append=-1) != 0
    text, ends = _group_bytes(listed, side, last)
    tokens = np.cumsum(counts[0] + counts[1])
    stops = ends[tokens - 1]
    listing = [text[a : b - 1].tobytes() for a, b in zip(np.concatenate(([0], stops[:-1])), stops, strict=True)]
    return {"n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "n_links": counts[3],
            "groups": listing, "link_a": link_a, "link_b": link_b, "link_doc": doc}


class _Run:
    """Texts encoded so far, until they make a run."""

    def __init__(self, a: _Side, b: _Side, radixes: int, digest: bool):
        self.a, self.b, self.radixes, self.digest = a, b, radixes, digest
        self.names: list = []
        self.where: list[int] = []  # rows of the texts with tokens
        self.ids: tuple[list, list] = ([], [])
        self.sizes: list[int] = []

    def add(self, names: list, texts: list[str | None]) -> None:
        held = [(i, t) for i, t in enumerate(texts) if t]
        some = [t for _, t in held]
        for (i, text), a, b in zip(held, self.a.encode(some), self.b.encode(some), strict=True):
            wanted = (" " + text).encode("utf-8")
            if all(b"".join(map(s.bytes.__getitem__, x)) == wanted for s, x in ((self.a, a), (self.b, b))):
                self.where.append(len(self.names) + i)
                self.ids[0].append(np.array(a, dtype=np.int64))
                self.ids[1].append(np.array(b, dtype=np.int64))
                self.sizes.append(len(wanted))
        self.names += names

    def row(self, p: int, seq: int) -> dict:
        n = len(self.names)
        out = {"p": p, "seq": seq, "doc_id": self.names, "groups": [""] * n}
        numbers = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        keys = docs = np.empty(0, np.int64)
        if self.where:
            ids = [np.concatenate(x) for x in self.ids]
            ends = [np.cumsum(s.sizes[x]) for s, x in zip((self.a, self.b), ids, strict=True)]
            found = align(*ids, *ends, np.cumsum(self.sizes))
            for name, values in numbers.items():
                values[self.where] = found[name]
            for i, listing in zip(self.where, found["groups"], strict=True):
                out["groups"][i] = hashlib.sha256(listing).hexdigest() if self.digest else listing.decode()
            keys = (found["link_b"] << _ID_BITS) | found["link_a"]
            docs = np.array(self.where)[found["link_doc"]]
        out |= numbers
        out["directories"], out["records"] = radix_parts(keys, docs, self.radixes)
        return out


def radix_parts(keys: np.ndarray, docs: np.ndarray, radixes: int) -> tuple[list[bytes], list[bytes]]:
    """Links as a directory (pairs by B and A id, totals) and the records behind it (per document), for each radix.

    The radix is the B id modulo ``radixes``, a power of two.
    """
    b, a, step = keys >> _ID_BITS, keys & ((1 << _ID_BITS) - 1), (1 << _ID_BITS) // radixes
    order = (b % radixes) * step + b // radixes
    records, times = np.unique((order << (_ID_BITS + _DOC_BITS)) | (a << _DOC_BITS) | docs, return_counts=True)
    pairs, first, size = np.unique(records >> _DOC_BITS, return_index=True, return_counts=True)
    totals = np.add.reduceat(times, first) if len(first) else first
    doc = records & ((1 << _DOC_BITS) - 1)
    radix, rank = np.divmod(pairs >> _ID_BITS, step)
    real = ((rank * radixes + radix) << _ID_BITS) | (pairs & ((1 << _ID_BITS) - 1))
    directories, parts = [], []
    bounds = np.searchsorted(radix, np.arange(radixes + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        at, to = (int(first[lo]) if lo < len(first) else 0), (int(first[hi]) if hi < len(first) else len(records))
        directories.append(pack(_gaps(real[lo:hi]), totals[lo:hi]) if hi > lo else b"")
        parts.append(pack(size[lo:hi], doc[at:to], times[at:to]) if hi > lo else b"")
    return directories, parts


def _runs(docs: DataFrame, path_a: str, path_b: str, run_bytes: int, radixes: int, digest: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _RUN_SCHEMA.format(id=f"array<{kind}>")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(BytePairs, path_a), _side(Pieces, path_b)
        p, seq, run, held = TaskContext.get().partitionId(), 0, _Run(a, b, radixes, digest), 0
        emit = lambda: pa.RecordBatch.from_pylist([run.row(p, seq)], schema=target)
        for piece in pieces(batches, "text", BATCH_BYTES):
            texts = piece.column("text").to_pylist()
            size = sum(len(t.encode()) for t in texts if t)
            if run.names and (held + size > run_bytes or len(run.names) + len(texts) >= 1 << _DOC_BITS):
                yield emit()
                seq, run, held = seq + 1, _Run(a, b, radixes, digest), 0
            run.add(piece.column("doc_id").to_pylist(), texts)
            held += size
        if run.names:
            yield emit()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


# --- counting ---


def merge_directories(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way heap merge: per B id, in order, its pairs in order and their summed totals."""
    heap, held = [], []
    for keys, totals in parts:
        if not len(keys):
            continue
        b = keys >> _ID_BITS
        starts = np.flatnonzero(np.diff(b, prepend=-1))
        held.append((keys, totals, np.append(starts, len(keys)).tolist()))
        heap.append((int(b[0]), len(held) - 1, 0))
    heapq.heapify(heap)
    while heap:
        top, found = heap[0][0], []
        while heap and heap[0][0] == top:
            _, i, block = heap[0]
            keys, totals, starts = held[i]
            found.append((keys[starts[block] : starts[block + 1]], totals[starts[block] : starts[block + 1]]))
            if block + 2 < len(starts):
                heapq.heapreplace(heap, (int(keys[starts[block + 1]] >> _ID_BITS), i, block + 1))
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            yield found[0]
            continue
        keys = np.concatenate([k for k, _ in found])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], np.concatenate([t for _, t in found])[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(totals, first)


def _opened(blobs: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for blob in blobs:
        gaps, totals = unpack(blob)
        yield np.cumsum(gaps), totals


def _joined(blocks: Iterable[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    found = list(blocks)
    return [np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(width)]


def _merged(directories: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """(radix, directory) from (radix, run, directory): fan_in at a time until one is left for each radix."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys, totals = _joined(merge_directories(_opened(rows["directory"])), 2)
        return pd.DataFrame({"radix": rows["radix"].iloc[:1], "run": rows["group"].iloc[:1], "directory": [pack(_gaps(keys), totals)]})

    while True:
        grouped = directories.withColumn("group", F.expr(f"run div {fan_in}"))
        directories = grouped.groupBy("radix", "group").applyInPandas(merge, "radix int, run long, directory binary")
        runs = -(-runs // fan_in)
        if runs <= 1:
            return directories.select("radix", "directory")


def _with_best(directory: bytes) -> bytes:
    """A directory's pairs with their counts and whether they are their B id's highest, side by side."""
    gaps, counts = unpack(directory)
    b = np.cumsum(gaps) >> _ID_BITS
    first = np.flatnonzero(np.diff(b, prepend=-1))
    top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(b))))
    return pack(gaps, counts, counts == top)


def contribution(directory: bytes, records: bytes, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> bytes:
    """Per document of a run: the sum of its links' counts, and how many links are their B id's best."""
    gaps, _ = unpack(directory)
    size, doc, times = unpack(records)
    at = np.searchsorted(keys, np.cumsum(gaps))
    sums, n_best = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
    np.add.at(sums, doc, np.repeat(counts[at], size) * times)
    np.add.at(n_best, doc, np.repeat(best[at], size) * times)
    return pack(sums, n_best)


def _contributions(parts: DataFrame, counted: DataFrame, runs: int, runs_a_task: int) -> DataFrame:
    """(run, sums) from the parts of all runs and the counts of their radix, which precede them in every task."""
    tasks = F.expr(f"explode(sequence(0, {max(runs - 1, 0) // runs_a_task})) AS task")
    none = F.lit(None)
    heads = counted.select("radix", tasks, F.lit(-1).cast("long").alias("run"), "directory", none.cast("binary").alias("records"))
    tails = parts.select("radix", F.expr(f"cast(run div {runs_a_task} AS int) AS task"), "run", "directory", "records")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[np.ndarray] = []
        for batch in batches:
            out: list = [[], []]
            for run, directory, records in zip(*(batch.column(c) for c in ("run", "directory", "records")), strict=True):
                if run.as_py() < 0:
                    gaps, counts, best = unpack(_with_best(directory.as_py()))
                    table = [np.cumsum(gaps), counts, best]
                    continue
                out[0].append(run.as_py())
                out[1].append(contribution(directory.as_py(), records.as_py(), *table))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["run", "sums"])

    dealt = heads.union(tails).repartition("radix", "task").sortWithinPartitions("radix", "task", "run")
    return dealt.mapInArrow(weigh, "run long, sums binary")


def _rows(runs: DataFrame, sums: DataFrame, kind: str) -> DataFrame:
    """The documents' rows of every run, with the contributions of all radixes added up."""
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    target = to_arrow_schema(StructType.fromDDL(schema))
    plain = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in plain}
                n = len(row["doc_id"])
                totals = np.zeros((2, n), np.int64)
                for blob in batch.column("found")[i].as_py() or ():
                    for into, part in zip(totals, unpack(blob), strict=True):
                        into[: len(part)] += part
                row |= {"count_sum": pa.array(totals[0]), "n_best": pa.array(totals[1])}
                yield pa.RecordBatch.from_arrays([row[f.name].cast(f.type) for f in target], schema=target)

    found = sums.groupBy("run").agg(F.collect_list("sums").alias("found"))
    return runs.select("run", *plain).join(found, "run", "left").mapInArrow(work, schema)


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, run_bytes: int = RUN_BYTES,
    radixes: int = RADIXES, fan_in: int = FAN_IN, runs_a_task: int = RUNS_A_TASK,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of ``docs`` (doc_id, text).

    A reads the tokenizers file ``path_a``, B the sentencepiece model ``path_b``. ``groups`` lists the
    ids between byte offsets where tokens of both end, ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the
    SHA-256 of that. ``n_links`` counts overlapping tokens, ``count_sum`` adds up how often the corpus links
    their ids, ``n_best`` counts links whose pair is its B id's most frequent, ties included.

    Null and empty texts, and texts that either tokenizer changes, have zeros and an empty ``groups``.
    Rows count as often as they occur, null and repeated ids too; other columns are ignored. A text is
    encoded whole, so one text and its ids must fit in a task. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    staged = stage(_runs(docs, path_a, path_b, run_bytes, radixes, digest), "alignment-runs")
    last = staged.agg(F.max("p"), F.max("seq")).first()
    if last[0] is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    width = last[1] + 1
    runs = (last[0] + 1) * width
    numbered = staged.withColumn("run", F.col("p").cast("long") * width + F.col("seq"))
    directories = numbered.select("run", F.posexplode("directories").alias("radix", "directory")).where("length(directory) > 0")
    counted = _merged(directories, runs, fan_in)
    both = F.posexplode(F.arrays_zip("directories", "records")).alias("radix", "part")
    parts = numbered.select("run", both).select(
        "radix", "run", F.col("part.directories").alias("directory"), F.col("part.records").alias("records")
    )
    parts = parts.where("length(directory) > 0")
    return _rows(numbered, _contributions(parts, counted, runs, runs_a_task), kind)
