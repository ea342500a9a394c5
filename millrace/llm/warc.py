"""WARC archives with a Zstandard dictionary: written and read as Spark jobs.

Each archive begins with a skippable frame that holds a dictionary built from its own records; every record is a frame of its own, so
one record can be read without the others. Records go to the files through Spark's text writer, which commits whole
tasks only and writes to any store that Spark knows. The writer needs a line separator: an empty skippable
frame, which decompressors pass over, stands between records.

Of records with equal payloads of at least ``LEAST_REVISITED`` bytes, that with the smallest page_id is a response, the
others are revisits of it without a payload. The dictionary is trained on the first ``SAMPLE_BYTES`` of an archive's
records; this bounds what a task holds besides one record.

Defined cases: a NULL html is an empty payload. A NULL url leaves the target out. Rows equal in page_id and payload
are all responses; a row without an id revisits one that has an id, and is a response if none has.
Line breaks in a url are percent-encoded. An empty table gives no archive and reads back as no record.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

LEAST_REVISITED = 100
SAMPLE_BYTES = 2 << 20
SAMPLE_RECORD = 64 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 6

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {url}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the samples, or made of their bytes where there are too few to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(made: zstandard.ZstdCompressionDict) -> bytes:
    raw = made.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def with_response(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, revisit`` for each row of ``pages``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    found = rows.join(first.filter("n > 1").drop("n"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISITED) -> None:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives below ``path``, one for each task."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size, pack = 0, None

        def started() -> Iterator[bytes]:
            nonlocal pack, waiting
            made = dictionary([r[:SAMPLE_RECORD] for r in waiting])
            pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
            yield dictionary_frame(made)
            for r in waiting:
                yield pack.compress(r)
            waiting = []

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out: list[bytes] = []
                for row in batch.slice(low, 256).to_pylist():
                    made = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"])
                    if pack is not None:
                        out.append(pack.compress(made))
                        continue
                    waiting.append(made)
                    size += len(made)
                    if size >= SAMPLE_BYTES:
                        out += started()
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
        if waiting:
            yield pa.RecordBatch.from_pydict({"value": pa.array(list(started()), pa.binary())})

    packed = with_response(pages, least).mapInArrow(frames, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below ``path``. A response whose payload does not fit its digest is an error."""
    columns = [c.split()[0] for c in _READ.split(", ")][: None if payloads else -1]
    schema = _READ if payloads else _READ.rsplit(", ", 1)[0]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                if not raw.size:
                    continue
                found: list[dict] = []
                for one in parse(raw):
                    found.append(one)
                    if len(found) >= 256:
                        yield _rows(found)
                        found = []
                yield _rows(found)

    def _rows(found: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], kinds.get(c, pa.string())) for c in columns})

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(records, schema)


def parse(raw: bytes | pa.Buffer) -> Iterator[dict]:
    """The records of one archive."""
    view = memoryview(raw)
    magic, size = struct.unpack("<II", view[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    made = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
    unpack = zstandard.ZstdDecompressor(dict_data=made)
    # One stream over all frames; the frames between records hold nothing.
    stream = io.BufferedReader(unpack.stream_reader(view[8 + size :], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("not a record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[key] = value
        block = stream.read(int(fields["Content-Length"]))
        stream.read(4)
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(head.decode().rpartition("Content-Length: ")[2])
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        if kind == "response" and (sha256(payload).hexdigest() != digest or len(payload) != length):
            raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not fit its digest")
        number = lambda key: int(fields[key]) if key in fields else None
        yield {
            "page_id": number("X-Page-Id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
        }
