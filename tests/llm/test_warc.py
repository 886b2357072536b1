from __future__ import annotations

import hashlib
import io
import random
import struct

import pytest

from tidewatch.llm import warc
from tidewatch.llm.queries import op9_warc

SCHEMA = "page_id long, url string, html string, digest string, size long, top long, payload string"


def test_round_trip(spark):
    big, other = "é" * 600, "z" * 1500
    rows = [
        (1, "http://a.test/x y\n", big), (7, None, big), (3, "u", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"),
        (6, "u", None), (8, "u", ""), (None, "u", big), (None, "u", other), (9, "u", "x" * 2_000_000), (10, "u", "a\r\n\r\nb\n\nWARC/1.1\r\n" * 90),
        (10, "u", "a\r\n\r\nb\n\nWARC/1.1\r\n" * 90),
    ]
    table = spark.createDataFrame([(*r, "d", 1, 2, "p") for r in rows], SCHEMA)
    got = warc.archive_round_trip(table).collect()
    assert len(got) == len(rows)
    wanted = []
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = payload == big.encode() and page != 7
        wanted.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None) == sorted(w for w in wanted if w[0] is not None)
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None} == {("revisit", 7), ("response", None)}
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archive_format():
    rng = random.Random(0)
    pages = [" ".join(rng.choice(["<p>", "text", "of", "a", "page", "</p>"]) for _ in range(150)).encode() for _ in range(300)]
    records = [warc.record(i, f"http://a.test/{i}", p, None, False) for i, p in enumerate(pages)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(records)) == 300
    raw = out.getvalue()
    kind, size = struct.unpack("<II", raw[:8])
    assert kind == warc.SKIPPABLE and raw[8 : 12] == struct.pack("<I", 0xEC30A437)
    assert raw[8 + size : 12 + size] == struct.pack("<I", warc.FRAME)
    assert list(warc.frames(io.BytesIO(raw))) == records
    plain = sum(len(warc.zstandard.ZstdCompressor().compress(r)) for r in records)
    assert len(raw) - size - 8 < plain * 0.8
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-3])))
    few = io.BytesIO()
    warc.write_archive(few, iter(records[:2]))
    assert list(warc.frames(io.BytesIO(few.getvalue()))) == records[:2] and list(warc.frames(io.BytesIO())) == []
    broken = records[0].replace(b" of ", b" OF ", 1)
    with pytest.raises(ValueError):
        warc.parse(broken)


def test_query_covers_all_pages(spark):
    assert op9_warc(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_archives_are_read_by_tasks_of_their_own(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * (1 + i % 300)) for i in range(400)] + [(400 + i, "u", "same " * 400) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, folder)
    archives = manifest.where("records > 0").count()
    read = warc.read_archives(manifest, folder)
    assert archives >= 6 and read.rdd.getNumPartitions() == archives
    assert sorted(r.page_id for r in read.collect()) == list(range(600))
    tasks = read.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert min(tasks) > 0 and sum(tasks) == 600


def test_small_payloads_are_not_joined(spark):
    pages = spark.createDataFrame([(1, "u", ""), (2, "u", "x" * 2000)], "page_id long, url string, html string")
    plan = warc.plan_records(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join") == 1
