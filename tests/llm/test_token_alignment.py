"""Tokenizer alignment against a plain count, and the counting structure on its own."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import token_alignment as ta

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def tokens_of(text):
    """[(id, start, end)] of both sides by offsets of the joined bytes; None where a side changes the text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return None
    coder = Tokenizer.from_file(A)
    coder.encode_special_tokens = True
    ids_a = coder.encode(" " + text, add_special_tokens=False).ids
    table = {c: bytes([b]) for c, b in ta._byte_letters().items()}
    parts_a = [b"".join(table[c] for c in coder.id_to_token(i)) for i in ids_a]
    model = SentencePieceProcessor(model_file=B)
    ids_b = model.encode(text)
    parts_b = []
    for i in ids_b:
        piece = model.id_to_piece(i)
        parts_b.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    out = []
    for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
        if b"".join(parts) != (" " + text).encode():
            return None
        at, side = 0, []
        for i, part in zip(ids, parts, strict=True):
            side.append((i, at, at + len(part)))
            at += len(part)
        out.append(side)
    return out


def by_definition(texts):
    tokens = [tokens_of(t) for t in texts]
    links = []
    for found in tokens:
        a, b = found or ([], [])
        links.append([(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]])
    count = Counter(pair for doc in links for pair in doc)
    top: dict = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for found, doc in zip(tokens, links, strict=True):
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = found
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, _, e in side if start < e <= end) for side in (a, b)]
            groups.append("|".join(inside))
            start = end
        best = sum(count[p] == top[p[1]] for p in doc)
        rows.append((len(a), len(b), len(ends), len(doc), best, sum(count[p] for p in doc), ";".join(groups)))
    return rows


TEXTS = [
    None, "", " ", "x", "the cat sat on the mat", "the cat sat on the mat", "the the the", "<|endoftext|> and <s> </s> <unk>", "été çà  et  là",
    "a▁b", "tab\tand\nline\r\n\n", "日本語と😀 emoji", "\u0000 nul", "ﬁ ligature Å", "of " * 300, "▁", "  ",
]


@pytest.mark.parametrize("shape", [{}, {"run_bytes": 60, "radixes": 4, "fan_in": 2, "runs_a_task": 3}, {"run_bytes": 1, "radixes": 1, "fan_in": 3}])
def test_against_the_definition(spark, babble, shape):
    texts = [*TEXTS, *(babble(i, 30) for i in range(6)), babble(1, 30)]
    ids = [None, 7, 7, *range(10, 10 + len(texts) - 3)]
    rows = [(i, t, 1, 2, "r", "g") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run int, radix int, records string, groups string").repartition(3)
    got = ta.align_tokenizers(docs, A, B, **shape).collect()
    wanted = by_definition(texts)
    plain = lambda rows: sorted(map(repr, rows))
    assert plain((r.doc_id, *(r[c] for c in NUMBERS), r.groups) for r in got) == plain((i, *w) for i, w in zip(ids, wanted, strict=True))
    if not shape:
        digested = ta.align_tokenizers(docs, A, B, digest=True).collect()
        sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
        assert plain((r.doc_id, r.groups) for r in digested) == plain((i, sha(w[-1])) for i, w in zip(ids, wanted, strict=True))


def test_empty_table_and_nothing_to_count(spark):
    schema = "doc_id long, text string"
    assert ta.align_tokenizers(spark.createDataFrame([], schema), A, B).count() == 0
    row = ta.align_tokenizers(spark.createDataFrame([(1, None)], schema), A, B).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_against_the_definition(spark, tmp_path):
    from tidewatch.llm.queries import op13_token_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 400").limit(25)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    wanted = by_definition([r.text for r in rows])
    got = {r.doc_id: r for r in op13_token_alignment(spark, str(tmp_path)).collect()}
    for doc, want in zip(rows, wanted, strict=True):
        sha = hashlib.sha256(want[-1].encode()).hexdigest() if want[-1] else ""
        assert (*(got[doc.doc_id][c] for c in NUMBERS), got[doc.doc_id].groups_sha256) == (*want[:-1], sha)


def test_merge_of_directories():
    rng, total = random.Random(3), Counter()
    parts = []
    for _ in range(9):
        found = Counter((rng.randrange(4) << 20 | rng.randrange(6)) for _ in range(rng.randrange(30)))
        total += found
        keys = np.array(sorted(found), dtype=np.int64)
        parts.append((keys, np.array([found[k] for k in keys.tolist()], dtype=np.int64)))
    blocks = list(ta.merge_directories(parts))
    assert [int(k[0]) >> 20 for k, _ in blocks] == sorted({k >> 20 for k in total})
    assert {int(k): int(n) for ks, ns in blocks for k, n in zip(ks, ns, strict=True)} == dict(total)


def test_blobs():
    for values in ([], [0], [255, 256], [1 << 40, 3]):
        packed = ta.pack(np.array(values, dtype=np.int64), np.array([True, False]))
        assert [x.tolist() for x in ta.unpack(packed)] == [values, [1, 0]]


def test_ranked_encoding_is_the_files_own(babble):
    side, rng = ta.BytePairs(A), random.Random(8)
    assert side.ranked is not None
    pools = ["abc XYZ 123 's 't'll", " \t\n\r\x0b\x0c\x85\u2003\u3000", "é ß Ω 中文 ́\u200d😀", "<|endoftext|>", "'S'T ’s٣½Ⅷ\x00\x1c\ufeff"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += [babble(i, 200) for i in range(20)]
    fast = side.encode(texts)
    side.ranked = None
    assert fast == side.encode(texts)
