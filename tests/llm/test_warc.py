import gzip
import hashlib
import random
import re
import zlib

import pytest

from wayfold.llm import warc
from wayfold.llm.common import scratch_path


def test_round_trip(spark):
    rng = random.Random(1)
    big = ["x" * 999, "y" * 1000, "é" * 600, "<p>" + "z" * 9_000_000]
    rows = [(i, rng.choice([None, "http://a/ b\n", "http://é.x/"]), rng.choice([None, "", "short", *big, f"{i}" * 900]), "k", 1) for i in range(80)]
    rows += [(3, "u", big[1], "k", 1), (3, "u", big[1], "k", 1), (200, "u", big[1], "k", 1), (200, "u", big[1], "k", 1), (None, "u", big[1], "k", 1), (None, None, None, "k", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, winner int").repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write(df, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, path).collect()), key=repr)
    best: dict = {}
    for i, _, h, *_ in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(i, best.get(h, -1))
    want = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        again = h in best and best[h] != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best[h] if again else None, None if again else raw))
    assert got == sorted(want, key=repr)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert any(b"WARC-Type: response" in gzip.decompress(bytes(f.content)) for f in files)  # any gzip reader reads them
    for f in files:  # nothing but members, a record each
        left = bytes(f.content)
        while left:
            member = zlib.decompressobj(31)
            plain = member.decompress(left)
            left = member.unused_data
            head, _, block = plain.partition(b"\r\n\r\n")
            assert plain.startswith(b"WARC/1.1\r\n") and len(block) == int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1]) + 4


def test_reader_takes_any_pieces_and_finds_faults():
    raw = warc.page_record(1, "http://a", b"abc", None) + b"\0" + warc.page_record(2, None, b"abc", 1) + b"\0\0"
    for size in (1, 7, 10_000):
        reader = warc.Reader()
        found = [warc.verified(r) for at in range(0, len(raw), size) for r in reader.feed(raw[at : at + size])]
        reader.close()
        assert [(f["page_id"], f["record_type"], f["refers_to"], f["payload_bytes"]) for f in found] == [(1, "response", None, 3), (2, "revisit", 1, 3)]
    reader = warc.Reader()
    list(reader.feed(raw[:60]))
    with pytest.raises(ValueError):
        reader.close()
    bad = warc.Record({**next(warc.Reader().feed(raw)).headers}, b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabX")
    with pytest.raises(ValueError):
        warc.verified(bad)


def test_empty(spark):
    path = scratch_path(spark, "warc-test")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
