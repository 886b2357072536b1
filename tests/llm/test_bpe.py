from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from tidewatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(count):
    rng = random.Random(5)
    parts = ["a", "th", "Ing", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "12", "é", "漢", "😀", "\x1c", "\x85", " ", "\xa0", "--", "...", "́", "ſ", "Ⅷ", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(count)]


def test_ids_of_the_library(ranks, reference):
    for lead in (True, False):
        engine = bpe.Encoder(ranks, public_tokenizers.PATTERN, blanks_lead=lead)
        for text in odd_texts(3000):
            assert engine.encode(text) == reference.encode_ordinary(text)


def test_long_words_and_small_caches(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 20)
    engine = bpe.Encoder(ranks, public_tokenizers.PATTERN, kept_bytes=1400)
    rng = random.Random(1)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdeé") for _ in range(4000)), "-" * 999, " " * 777 + "x"]
    for text in texts + odd_texts(300):
        assert engine.encode(text) == reference.encode_ordinary(text)


def test_transducer_against_the_definition():
    ranks = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"dd", b"ddd", b"abcd"]):
        ranks[token] = 256 + i
    machine, rng = bpe.Transducer(ranks), random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14)))
        wanted = tuple(ranks[p] for p in bpe.merged(data, ranks))
        assert machine.word(data) == ((ranks[data],) if data in ranks else wanted)


def test_lookahead_on_short_words(ranks, reference, monkeypatch):
    # Words of up to SHORT bytes go another way; without it the states take all words.
    monkeypatch.setattr(bpe, "SHORT", 0)
    monkeypatch.setattr(bpe.Transducer, "_short", None)
    engine = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in odd_texts(1000):
        assert engine.encode(text) == reference.encode_ordinary(text)
    own = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"dd", b"ddd", b"abcd"]):
        own[token] = 256 + i
    machine, rng = bpe.Transducer(own), random.Random(3)
    for _ in range(2000):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14)))
        wanted = tuple(own[p] for p in bpe.merged(data, own))
        assert machine.word(data) == ((own[data],) if data in own else wanted)
    assert machine.moves


def test_stream_decoding():
    tokens = [bytes([b]) for b in range(256)]
    rng = random.Random(3)
    samples = ["é漢😀a".encode(), bytes(rng.randrange(256) for _ in range(400)), b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80x"]
    for data in samples:
        machine, said, at = bpe.StreamDecoder(tokens), "", 0
        while at < len(data):
            step = rng.randrange(1, 4)
            said += machine.push(data[at : at + step])
            at += step
        assert said + machine.close() == data.decode("utf-8", "replace")


def test_tables(spark, reference):
    schema = "doc_id long, text string, ids string"
    rows = [(1, "Hello, wörld\n\n x"), (2, None), (3, ""), (1, "Hello, wörld\n\n x"), (None, "a" * 100_000), (5, "<|endoftext|>")]
    table = spark.createDataFrame([(*r, "z") for r in rows], schema)
    encoded = bpe.encode_documents(table, PATH, public_tokenizers.PATTERN)
    got = bpe.decode_documents(encoded.withColumn("copy", encoded["ids"]), PATH).collect()
    wanted = sorted((str(d), reference.encode_ordinary(t or ""), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), r.copy, r.text) for r in got) == wanted
    once = bpe.encode_documents(table, PATH, public_tokenizers.PATTERN, decode=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.text) for r in once) == wanted
    empty = bpe.encode_documents(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN)
    assert bpe.decode_documents(empty, PATH).count() == 0


def test_what_a_worker_keeps_is_bounded(ranks, reference):
    engine, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN, kept_bytes=60_000), random.Random(4)
    most, seen = 0, set()
    for _ in range(200):
        words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 12))) for _ in range(40)]
        text = " ".join([*words, "often", "met,"])
        seen |= {*words}
        assert engine.encode(text) == reference.encode_ordinary(text)
        held = [engine.matches, engine.after_blank, engine.first, *engine.earlier]
        most = max(most, sum(map(len, held)))
        assert engine.kept <= 31_000 and "often" in engine.after_blank | engine.earlier[1]
    assert 100 < most < 400 < len(seen)


def test_query_digests(spark, reference):
    import hashlib

    from tidewatch.llm.queries import op4_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op4_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), joined, hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
