"""Readers of formats that Spark has no reader for: OSM PBF, change files (OSC) and SQLite gazetteers.

Files come through Spark's binaryFile source, so any file system will do; decoding runs in
Arrow-batched maps. A PBF file is first cut into its blobs, which are dealt out and decoded apart.
"""

from __future__ import annotations

import gzip
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG_LIST = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))


# ---- OSM change files

OPS = "seq long, pos int, action string, kind string, id long, version long, lon double, lat double, tags array<struct<key:string,value:string>>"
_OPS = pa.schema([("seq", pa.int64()), ("pos", pa.int32()), ("action", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("version", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", TAG_LIST)])


def _number(text: str | None, kind, other):
    try:
        return kind(text)
    except (TypeError, ValueError):
        return other


def parse_osc(raw: bytes) -> Iterator[dict]:
    """Operations of a change file, gzip or plain, in order; references and members are passed over, a bad id is 0."""
    root = ET.fromstring(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    for block in root:
        if block.tag in ("create", "modify", "delete"):
            for e in block:
                if e.tag in ("node", "way", "relation"):
                    tags = [{"key": t.get("k"), "value": t.get("v")} for t in e if t.tag == "tag"]
                    yield {"action": block.tag, "kind": e.tag, "id": _number(e.get("id"), int, 0), "version": _number(e.get("version"), int, 0), "lon": _number(e.get("lon"), float, None), "lat": _number(e.get("lat"), float, None), "tags": tags}


def osc_operations(files: DataFrame) -> DataFrame:
    """Of ``path, content`` rows (batch or stream): the operations, numbered; seq is the file name's leading number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [x | {"seq": seq, "pos": i} for i, x in enumerate(parse_osc(raw))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_OPS)

    return files.select(F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("long").alias("seq"), "content").mapInArrow(run, OPS)


def read_osc(spark: SparkSession, path: str) -> DataFrame:
    return osc_operations(spark.read.format("binaryFile").option("pathGlobFilter", "*.osc*").load(path).select("path", "content"))


# ---- SQLite gazetteers


def read_sqlite(spark: SparkSession, path: str, table: str, columns: dict[str, str]) -> DataFrame:
    """A table of SQLite files as text and numbers; columns: name to Spark type. Each file is opened from a copy beside its task, read only."""
    if not table.isidentifier() or not all(c.isidentifier() for c in columns):
        raise ValueError(f"{table} {columns}")
    names, schema = list(columns), ", ".join(f"{c} {t}" for c, t in columns.items())
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [arrow[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(raw)
                    f.flush()
                    db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    rows = db.execute(f"SELECT {', '.join(names)} FROM {table}")
                    while some := rows.fetchmany(5_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_wof(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``spr``, ``names`` and ``geojson`` of a who's-on-first file."""
    spr = read_sqlite(spark, path, "spr", {"id": "long", "parent_id": "long", "name": "string", "placetype": "string", "country": "string", "latitude": "double", "longitude": "double", "is_current": "int", "is_deprecated": "int", "is_ceased": "int"})
    return spr, read_sqlite(spark, path, "names", {"id": "long", "language": "string", "name": "string", "privateuse": "string"}), read_sqlite(spark, path, "geojson", {"id": "long", "body": "string"})


# ---- OSM PBF


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        elif key & 7 == 2:
            n, at = _varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif key & 7 == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            value, at = raw[at : at + 8], at + 8
        yield key >> 3, value


def _packed(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = _varint(raw, at)
        out.append(v)
    return out


def _zigzag(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def _deltas(raw: bytes) -> list[int]:
    out, total = [], 0
    for v in _packed(raw):
        total += _zigzag(v)
        out.append(total)
    return out


def pbf_blobs(raw: bytes) -> Iterator[bytes]:
    """The data blobs of a file, still packed."""
    at = 0
    while at + 4 <= len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        head = dict(_fields(raw[at + 4 : at + 4 + n]))
        at += 4 + n
        if head.get(1) == b"OSMData":
            yield raw[at : at + head[3]]
        at += head[3]


def pbf_entities(blob: bytes) -> Iterator[dict]:
    """Nodes, ways and relations of a blob."""
    parts = dict(_fields(blob))
    raw = parts[1] if 1 in parts else zlib.decompress(parts[3])
    strings: list[str] = []
    groups, scale, lat0, lon0 = [], 100, 0, 0
    for k, v in _fields(raw):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in _fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v
        elif k == 20:
            lon0 = v
    deg = lambda v, base: (base + scale * v) / 1e9
    pairs = lambda f: [{"key": strings[a], "value": strings[b]} for a, b in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")), strict=True)]
    for group in groups:
        for k, v in _fields(group):
            if k == 1:
                f = dict(_fields(v))
                yield {"kind": "node", "id": _zigzag(f[1]), "lon": deg(_zigzag(f[9]), lon0), "lat": deg(_zigzag(f[8]), lat0), "tags": pairs(f)}
            elif k == 2:
                f = dict(_fields(v))
                ids, lats, lons, flat = _deltas(f.get(1, b"")), _deltas(f.get(8, b"")), _deltas(f.get(9, b"")), _packed(f.get(10, b""))
                at = 0
                for i, la, lo in zip(ids, lats, lons, strict=True):
                    tags = []
                    while at < len(flat) and flat[at]:
                        tags.append({"key": strings[flat[at]], "value": strings[flat[at + 1]]})
                        at += 2
                    at += 1
                    yield {"kind": "node", "id": i, "lon": deg(lo, lon0), "lat": deg(la, lat0), "tags": tags}
            elif k == 3:
                f = dict(_fields(v))
                yield {"kind": "way", "id": f[1], "tags": pairs(f), "refs": _deltas(f.get(8, b""))}
            elif k == 4:
                f = dict(_fields(v))
                kinds = ("node", "way", "relation")
                yield {"kind": "relation", "id": f[1], "tags": pairs(f), "members": [{"role": strings[r], "ref": m, "kind": kinds[t]} for r, m, t in zip(_packed(f.get(8, b"")), _deltas(f.get(9, b"")), _packed(f.get(10, b"")), strict=True)]}


_ENTITY = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", TAG_LIST), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("role", pa.string()), ("ref", pa.int64()), ("kind", pa.string())])))])
ENTITY = "kind string, id long, lon double, lat double, tags array<struct<key:string,value:string>>, refs array<long>, members array<struct<role:string,ref:long,kind:string>>"


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """All entities of OSM PBF files, blob by blob."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for blob in pbf_blobs(raw):
                    yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = list(pbf_entities(blob))
                for at in range(0, len(rows), 4_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 4_000], schema=_ENTITY)

    blobs = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "blob binary")
    return blobs.repartition(spark.sparkContext.defaultParallelism * 2).mapInArrow(run, ENTITY)


def pbf_tables(entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """nodes (id, lon, lat, tags), ways (way_id, tags), refs (way_id, pos, node_id), members (rel_id, way_id, role, member_pos)."""
    nodes = entities.where("kind = 'node'").select("id", "lon", "lat", "tags")
    ways = entities.where("kind = 'way'").select(F.col("id").alias("way_id"), "tags")
    refs = entities.where("kind = 'way'").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
    members = entities.where("kind = 'relation'").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("member_pos", "m")).where("m.kind = 'way' AND m.role IN ('outer', 'inner', '')").select("rel_id", F.col("m.ref").alias("way_id"), F.col("m.role").alias("role"), "member_pos")
    return nodes, ways, refs, members
