"""WARC archives of pages with a Zstandard dictionary in front, and their reader.

Each task writes one archive: its first records train a dictionary, which is embedded in a
leading skippable frame, and every record is then compressed as a frame of its own, so a reader
can begin at any record. The archive of a task is committed by its row in the manifest, which
Spark writes; files of failed or repeated attempts are in no manifest and never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stage, stage_path

REVISIT_BYTES = 1000
DICTIONARY_BYTES = 64 * 1024
SAMPLE_BYTES = 4_000_000  # of an archive's first records, for its dictionary
# Fixed by the format: skippable frame that holds a dictionary, and the frame magic.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest_text(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only; its Content-Length is the payload's."""
    sha1 = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = "none" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", _digest_text(sha1)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples; none where there are too few of them to train on."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples)
    except zstandard.ZstdError:  # samples too alike
        return None


def write_archive(out, records: Iterator[bytes], level: int = 3) -> int:
    """Write records to a binary stream; the number written."""
    first: list[bytes] = []
    held = 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    trained = train(first)
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    if trained is not None:
        raw = trained.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    count = 0
    for source in (first, records):
        for r in source:
            out.write(packer.compress(r))
            count += 1
    return count


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head = stream.read(8)
    trained, ahead = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        trained = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
        ahead = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    while ahead or (ahead := stream.read(1 << 18)):
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(ahead))
            if frame.eof:
                ahead = frame.unused_data
                break
            ahead = stream.read(1 << 18)
            if not ahead:
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")

    def page(name: str | None) -> int | None:
        inner = None if name is None else name.removeprefix("<urn:page:").removesuffix(">")
        return None if inner in (None, "none") else int(inner)

    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": stated.hex(),
        "record_type": kind,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
        "target_uri": fields.get("WARC-Target-URI"),
    }


def plan_records(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit), one row per page.

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response; rows
    repeated with that page_id are responses too. Payloads are held equal by SHA-1 and length.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    same = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size")
    tops = same.agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    large = rows.where(F.col("size") >= least_bytes)
    joined = large.join(tops.select("digest", "size", "top"), ["digest", "size"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    found = joined.select("page_id", "url", "payload", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))
    # Smaller ones match nothing and stay where they are: they would meet on few keys, the empty ones on one.
    small = rows.where(F.col("size") < least_bytes)
    return found.union(small.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archive every page below ``folder`` (any address that pyarrow opens); the manifest (path, records)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for p, u, x, r, v in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], b["revisit"], strict=True):
                    yield record(None if pd.isna(p) else int(p), u, bytes(x), None if pd.isna(r) else int(r), bool(v))

        store, place = pafs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        path = f"{place}/part-{uuid.uuid4().hex}.warc.zst"
        with store.open_output_stream(path) as out:
            count = write_archive(out, records())
        yield pd.DataFrame({"name": [path.rsplit("/", 1)[1]], "records": [count]})

    return stage(plan_records(pages, least_bytes).mapInPandas(run, "name string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives that the manifest names; ``payloads`` adds the payload.

    Every archive is read by a task of its own, so reading back is as wide as writing was.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", *["payload"] * payloads]
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, expected in zip(b["name"], b["records"], strict=True):
                held, total = [], 0
                with store.open_input_stream(f"{place}/{name}") as stream:
                    for raw in frames(stream):
                        held.append(parse(raw))
                        total += 1
                        if len(held) == 500:
                            yield as_frame(held)
                            held = []
                if held:
                    yield as_frame(held)
                if total != expected:
                    raise ValueError(f"{name} has {total} records, the manifest {expected}")

    def as_frame(held: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    written = manifest.where("records > 0")
    # The names, a row per archive, are numbered and dealt to as many tasks, which AQE leaves alone.
    place = F.row_number().over(Window.orderBy("name")) - 1
    spread = written.withColumn("place", place).repartitionById(max(1, written.count()), F.col("place").cast("int"))
    return spread.mapInPandas(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def archive_round_trip(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and read the archives back.

    Null html is an empty payload; a null url leaves out the target address; a null page_id reads
    back as null, counts as least among equal payloads, and responds if all of them are null.
    Repeated rows give a record each; an empty table gives no rows. Other columns are not read.
    """
    folder = stage_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(pages, folder, least_bytes), folder)
