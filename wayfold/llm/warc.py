"""WARC archives: one gzip member per record, written from a table and read back sequentially.

Writing: a page whose payload equals that of a page with a larger id, and is not small,
becomes a revisit record that names the other; the largest id keeps the response. Winners
are found by a partially aggregated ``max`` over digests, and joined back by digest (both
sides are plain shuffles; Spark splits a hot digest's partition, and small payloads, which need no partner, are
dealt out by a hash of their own). Each task packs its
records into chunks of whole gzip members; a file is some of these chunks. Chunks are
written through Spark's own text writer, so any file system will do and failed tasks
leave nothing; what it puts after each chunk is a ``warcinfo`` record, so that an archive
holds nothing but records.

Reading: files are streamed through an incremental zlib decompressor, member by member;
record headers are parsed, blocks are framed by Content-Length and digests are verified. Zero
bytes between members are skipped. Spark hands a file over as one value: archives of 2 GB or more are refused by it.

Defined results: null html is an empty payload; null url is recorded as ``urn:wayfold:none``;
repeated rows are records of their own (those with the winning id all stay responses);
other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALLEST_SHARED = 1_000
"""Payloads with fewer bytes are always written in full."""
CHUNK_BYTES = 4 << 20
CHUNKS_PER_FILE = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f  ]")


def digest_header(raw: bytes) -> str:
    return f"sha1:{base64.b32encode(hashlib.sha1(raw).digest()).decode()}"


def digest_hex(header: str) -> str:
    return base64.b32decode(header.partition(":")[2]).hex()


def page_urn(page_id: int | None) -> str:
    return f"<urn:wayfold:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.rstrip(">").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", digest_header(block)), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, of: int | None) -> bytes:
    """A response with its payload, or, if ``of`` is given, a revisit of that page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "urn:wayfold:none" if url is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    headers = [("WARC-Record-ID", page_urn(page_id)), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest_header(payload))]
    if of is None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Refers-To", page_urn(of)), ("WARC-Profile", PROFILE)], http)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


class Reader:
    """Feeds on pieces of an archive, of any size, and gives its records in order."""

    def __init__(self) -> None:
        self._zip = None
        self._plain = bytearray()
        self._headers: dict[str, str] | None = None

    def feed(self, data: bytes) -> Iterator[Record]:
        while data:
            if self._zip is None:
                data = data.lstrip(b"\0")
                if not data:
                    return
                self._zip = zlib.decompressobj(31)
            self._plain += self._zip.decompress(data)
            data = b""
            ended = self._zip.eof
            if ended:
                data, self._zip = self._zip.unused_data, None
            yield from self._framed()
            if ended and (self._plain or self._headers is not None):
                raise ValueError("a gzip member ends within a record")

    def _framed(self) -> Iterator[Record]:
        while True:
            if self._headers is None:
                at = self._plain.find(b"\r\n\r\n")
                if at < 0:
                    return
                version, *lines = bytes(self._plain[:at]).decode().split("\r\n")
                if not version.startswith("WARC/1."):
                    raise ValueError(f"not a WARC record: {version[:20]!r}")
                self._headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                del self._plain[: at + 4]
            size = int(self._headers["content-length"])
            if len(self._plain) < size + 4:
                return
            if self._plain[size : size + 4] != b"\r\n\r\n":
                raise ValueError("Content-Length does not frame the block")
            out = Record(self._headers, bytes(self._plain[:size]))
            del self._plain[: size + 4]
            self._headers = None
            yield out

    def close(self) -> None:
        if self._zip is not None or self._plain or self._headers is not None:
            raise ValueError("the archive ends within a record")


def verified(r: Record) -> dict:
    """A page record's row; raises if a digest or a length does not hold."""
    h = r.headers
    if digest_header(r.block) != h["warc-block-digest"]:
        raise ValueError(f"block digest of {h.get('warc-record-id')}")
    head, _, payload = r.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    if r.kind == "response" and (len(payload) != size or digest_header(payload) != h["warc-payload-digest"]):
        raise ValueError(f"payload of {h.get('warc-record-id')}")
    return {"page_id": page_of(h["warc-record-id"]), "url": h["warc-target-uri"], "payload": payload if r.kind == "response" else None, "payload_bytes": size, "payload_digest": digest_hex(h["warc-payload-digest"]), "record_type": r.kind, "refers_to": page_of(h["warc-refers-to"]) if r.kind == "revisit" else None}


def write(pages: DataFrame, path: str, smallest: int = SMALLEST_SHARED) -> None:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) as archives in the folder ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= smallest, F.sha1("payload")))
    twice = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select("digest", "winner")
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    own = F.concat(F.lit("small "), F.xxhash64("page_id", "payload").cast("string"))  # no digest is like this
    rows = rows.withColumn("digest", F.coalesce("digest", own)).join(twice, "digest", "left").select("page_id", "url", "payload", F.when(revisit, F.col("winner")).alias("of"))

    info = record("warcinfo", [("WARC-Record-ID", "<urn:wayfold:info>"), ("Content-Type", "application/warc-fields")], b"software: wayfold\r\nformat: WARC File Format 1.1\r\n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    held = [info]
                held.append(page_record(*row))
                size += len(held[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    chunks = rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    chunks.write.option("encoding", "ISO-8859-1").option("lineSep", info.decode("latin-1")).option("maxRecordsPerFile", CHUNKS_PER_FILE).option("compression", "none").text(path)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of each page record below ``path``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader, out, size, whole = Reader(), [], 0, memoryview(batch.column(0)[i].as_buffer())
                for at in range(0, len(whole), 1 << 16):
                    for r in reader.feed(bytes(whole[at : at + (1 << 16)])):
                        if r.kind not in ("response", "revisit"):
                            continue
                        out.append(verified(r) | ({} if payloads else {"payload": None}))
                        size += len(r.block)
                        if size > CHUNK_BYTES or len(out) >= 2_000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                reader.close()
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN w.winner IS NOT NULL AND d.page_id IS DISTINCT FROM w.winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM w.winner THEN w.winner END AS refers_to
FROM d LEFT JOIN w USING (payload_digest)
"""
