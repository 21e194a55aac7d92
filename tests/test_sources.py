import gzip
import json
import sqlite3
import struct
import zlib

import pandas as pd
import pytest

from wayfold.operators import joins
from wayfold.schema import tag
from wayfold.sources import binary, files
from wayfold.streaming import replicate as rep


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def names_of(row):
    return [(n.lang, n.value) for n in row["names"]]


def test_openaddresses(spark, tmp_path):
    p = write(tmp_path / "oa.csv", "LON,LAT,NUMBER,STREET,UNIT,CITY,DISTRICT,REGION,POSTCODE,ID,HASH\n3.25,51.5,48,Korngasse,2c,Norvale,,,4410,1,abc\n0,0,1,X,,,,,,,\n9.5,47.1,,Y,,,,,,,\n9.5,47.1,3,,,,,,,,\n")
    rows = files.openaddresses(spark, p).collect()
    assert len(rows) == 1 and names_of(rows[0]) == [("default", "48 Korngasse, 2c")] and rows[0].gid == "oa:address:abc" and rows[0].level == 2
    assert {t.key: t.value for t in rows[0].tags} == {"addr:housenumber": "48", "addr:street": "Korngasse", "addr:unit": "2c", "addr:city": "Norvale", "addr:postcode": "4410"}


def test_geonames(spark, tmp_path):
    row = lambda i, n, a, cls, code, pop: "\t".join([str(i), n, a, "", "47.14", "9.52", cls, code, "QX", "", "", "", "", "", str(pop), "", "", "", ""])
    p = write(tmp_path / "g.txt", "\n".join([row(1, "Norvale", "Norvale", "P", "PPLC", 7310), row(2, "Hürlau", "Hurlau", "P", "PPLA", 0), row(3, "Hill", "Hill", "T", "MT", 0), row(4, "Old", "Old", "P", "PPLH", 0), row(5, "Part", "Part", "P", "PPLX", 1)]))
    rows = {r.names[0].value: r for r in files.geonames(spark, p).collect()}
    assert set(rows) == {"Norvale", "Hürlau", "Part"} and rows["Part"].kind == "neighborhood" and rows["Norvale"].gid == "geonames:locality:1"
    assert names_of(rows["Hürlau"]) == [("default", "Hürlau"), ("ascii", "Hurlau")] and {t.key: t.value for t in rows["Norvale"].tags}["population"] == "7310"
    q = write(tmp_path / "pc.txt", "QX\t4410\tNorvale\t\t\t\t\t\t\t47.14\t9.52\t4\n\t4411\tOstrin\t\t\t\t\t\t\t47.2\t9.5\t4\nQX\t\tX\t\t\t\t\t\t\t47\t9\t1\nQX\t9\tX\t\t\t\t\t\t\tNaN\t9\t1\n")
    rows = {r.names[0].value: r for r in files.geonames_postcodes(spark, q).collect()}
    assert set(rows) == {"4410", "4411"} and names_of(rows["4410"])[1] == ("default", "4410 Norvale") and rows["4410"].gid == "geonames:postalcode:QX-4410" and ":h" in rows["4411"].gid


def test_generic_csv_and_geojson(spark, tmp_path):
    p = write(tmp_path / "a.csv", "Longitude, Latitude ,name,kind,pop,color\n9.5,47.1,A,town,12,red\n,47,B,,,\n9,47,,,,\n")
    (r,) = files.generic_csv(spark, p).collect()
    assert (r.kind, r.lon, {t.key: t.value for t in r.tags}) == ("city", 9.5, {"color": "red", "population": "12"})
    assert files.generic_csv(spark, write(tmp_path / "b.csv", "name\nA\n")).collect() == []
    f = lambda g, **p: {"type": "Feature", "geometry": g, "properties": p}
    doc = {"type": "FeatureCollection", "features": [f({"type": "Point", "coordinates": [9.5, 47.1]}, name="P", kind="city", n=3), f({"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}, name="Q", **{"name:de": "Qd"}), f({"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, name="L"), f({"type": "Point", "coordinates": [1, 1]}), f({"type": "MultiPolygon", "coordinates": [[[[5, 6], [7, 8], [5, 6]]]]}, name="M")]}
    rows = {r.names[0].value: r for r in files.geojson(spark, write(tmp_path / "a.json", json.dumps(doc))).collect()}
    assert set(rows) == {"P", "Q", "M"} and (rows["Q"].lon, rows["Q"].lat, rows["M"].lon) == (1.0, 2.0, 5.0)
    assert names_of(rows["Q"])[1] == ("de", "Qd") and {t.key: t.value for t in rows["P"].tags} == {"n": "3"}


def test_geoparquet_overture_buildings(spark, tmp_path):
    point = lambda x, y: struct.pack("<BIdd", 1, 1, x, y)
    pd.DataFrame({"id": ["1", "2", "3"], "name": ["A", "", "C"], "geometry": [point(9.5, 47.1), point(1, 1), point(0, 0)], "pop": [3, 4, 5]}).to_parquet(tmp_path / "p.parquet")
    (r,) = files.geoparquet(spark, str(tmp_path / "p.parquet"), keep=["pop"]).collect()
    assert (r.lon, r.gid, r.tags[0].value) == (9.5, "generic:venue:1", "3")
    (r,) = files.overture(spark, str(tmp_path / "p.parquet"), "places").collect()
    assert r.gid == "overture:place:1" and r.source == "overture"
    pd.DataFrame({"id": ["7"], "number": ["12"], "street": ["Main"], "lon": [9.5], "lat": [47.1]}).to_parquet(tmp_path / "a.parquet")
    (r,) = files.overture(spark, str(tmp_path / "a.parquet"), "addresses").collect()
    assert r.gid == "overture:address:7" and names_of(r) == [("default", "12 Main")]
    ring = lambda s: struct.pack("<I10d", 5, 0, 0, s, 0, s, s, 0, s, 0, 0)
    poly = lambda s: struct.pack("<BII", 1, 3, 1) + ring(s)
    pd.DataFrame({"geometry": [struct.pack("<BII", 1, 6, 2) + poly(1) + poly(3), point(1, 1)], "height": [8.5, 1.0]}).to_parquet(tmp_path / "b.parquet")
    (r,) = files.buildings(spark, str(tmp_path / "b.parquet")).collect()
    assert (r.max_x, r.lon, r.height, len(r.outer_ring)) == (3.0, 1.5, 8.5, 5) and r.id.startswith("h")


def test_wof(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "w.db")
    db.executescript("CREATE TABLE spr(id,parent_id,name,placetype,country,latitude,longitude,is_current,is_deprecated,is_ceased); CREATE TABLE names(id,language,name,privateuse); CREATE TABLE geojson(id,body);")
    db.executemany("INSERT INTO spr VALUES (?,?,?,?,?,?,?,?,?,?)", [(1, -1, "L", "country", "QX", 47.1, 9.5, 1, 0, 0), (2, 1, "R", "region", "QX", 47.1, 9.5, -1, 0, 0), (3, 2, "V", "locality", "QX", 47.1, 9.5, 1, 0, 0), (4, 3, "N", "localadmin", "QX", 47.1, 9.5, 1, 0, 0), (5, 1, "gone", "locality", "QX", 47.1, 9.5, 0, 0, 0), (6, 1, "zero", "locality", "QX", 0, 0, 1, 0, 0), (7, 1, "odd", "venue", "QX", 1, 1, 1, 0, 0)])
    db.executemany("INSERT INTO names VALUES (?,?,?,?)", [(3, "deu", "Fau", "preferred"), (3, "fra", "x", "variant")])
    db.commit()
    spr, names, _ = binary.read_wof(spark, str(tmp_path / "w.db"))
    rows = {r.id: r for r in joins.wof_records(spr, names).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[4].kind == "county" and [(n.lang, n.value) for n in rows[3]["names"]] == [("default", "V"), ("deu", "Fau")]
    chains = {r.id: r.admin_path for r in joins.parent_chains(spr.select("id", "parent_id")).collect()}
    assert chains[4] == [1, 2, 3] and chains[1] == []
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (9, None), (4, 77)], "id long, parent_id long")
    assert {r.id: r.admin_path for r in joins.parent_chains(loop).collect()} == {1: [2], 2: [1], 3: [9], 9: [], 4: []}


OSC = """<osmChange version="0.6"><create><node id="1" version="1" lat="47.1" lon="9.5"><tag k="name" v="A"/></node><way id="5" version="2"><nd ref="1"/><tag k="note" v="x"/></way></create><modify><node id="1" version="3" lat="47.2" lon="9.6"/></modify><delete><relation id="x" version="4"/></delete></osmChange>"""


def test_replication(spark, tmp_path):
    ops = list(binary.parse_osc(OSC.encode()))
    assert [(o["action"], o["kind"], o["id"], o["version"], len(o["tags"])) for o in ops] == [("create", "node", 1, 1, 1), ("create", "way", 5, 2, 1), ("modify", "node", 1, 3, 0), ("delete", "relation", 0, 4, 0)]
    land = tmp_path / "land"
    land.mkdir()
    (land / "000000007.osc.gz").write_bytes(gzip.compress(OSC.encode()))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    dry = rep.replicate(spark, str(land), out, ck, dry_run=True)
    assert {(r.kind, r.action): (r.n, r.taggable) for r in dry.collect()} == {("node", "create"): (1, 1), ("way", "create"): (1, 0), ("node", "modify"): (1, 0), ("relation", "delete"): (1, 0)}
    assert not (tmp_path / "ck").exists()
    rep.replicate(spark, str(land), out, ck)
    assert sorted((r.kind, r.id, r.version) for r in rep.current(spark, out).collect()) == [("node", 1, 3), ("way", 5, 2)]
    rep.replicate(spark, str(land), out, ck)  # nothing new
    assert spark.read.parquet(f"{out}/histogram").count() == 4
    (land / "000000008.osc").write_text('<osmChange><delete><way id="5" version="3"/></delete></osmChange>')
    rep.replicate(spark, str(land), out, ck)
    assert sorted((r.kind, r.id) for r in rep.current(spark, out).collect()) == [("node", 1)]
    assert spark.read.parquet(f"{out}/dirty_tiles").where("batch = 0").count() == 3  # two points in one tile of each level
    seqs = spark.createDataFrame([(7,), (8,), (10,)], "seq long")
    assert sorted(r.seq for r in rep.contiguous(seqs, 6).collect()) == [7, 8] and sorted(r.seq for r in rep.contiguous(seqs, 6, 1).collect()) == [7] and rep.contiguous(seqs, 3).collect() == []
    assert rep.status(9, 7)["lag"] == 2


def test_replication_stops_at_a_gap(spark, tmp_path):
    assert rep.gap([7, 8, 9], 6) is None and rep.gap([9, 7], 6) == 8 and rep.gap([8], 6) == 7 and rep.gap([5, 7], 6) is None and rep.gap([4, 6], None) == 5 and rep.gap([], 3) is None
    land = tmp_path / "land"
    land.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    one = lambda n: (land / f"{n:09}.osc").write_text(f'<osmChange><create><node id="{n}" version="1" lat="1" lon="2"/></create></osmChange>')
    one(1)
    rep.replicate(spark, str(land), out, ck)
    one(3)
    with pytest.raises(Exception, match="change file 2 is missing"):
        rep.replicate(spark, str(land), out, ck)
    assert [r.id for r in rep.current(spark, out).collect()] == [1]
    assert [(r.action, r.n) for r in rep.replicate(spark, str(land), out, ck, dry_run=True).collect()] == [("create", 1)]
    one(2)
    rep.replicate(spark, str(land), out, ck)
    assert sorted(r.id for r in rep.current(spark, out).collect()) == [1, 2, 3] and rep.replicate(spark, str(land), out, ck, dry_run=True).collect() == []


def test_token_buckets(spark, tmp_path):
    from wayfold.streaming import limits

    assert limits.decide([0, 0, 0, 1, 5], 2.0, None, 1.0, 2.0) == ([True, True, False, True, True], 1.0, 5)
    (tmp_path / "in").mkdir()
    rows = [{"key": k, "id": i, "at": f"2024-01-01T00:00:{s:02}Z"} for i, (k, s) in enumerate([("a", 0), ("a", 0), ("a", 0), ("b", 0), ("a", 1), (None, 3)])]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    requests = spark.readStream.schema("key string, id long, at timestamp").json(str(tmp_path / "in"))
    query = limits.limited(requests, 1.0, 2.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def _varint(v):
    out = b""
    while True:
        out += bytes([v & 0x7F | (0x80 if v > 0x7F else 0)])
        v >>= 7
        if not v:
            return out


def _msg(*fields):
    out = b""
    for k, v in fields:
        out += _varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v
    return out


def _zz(v):
    return _varint(v << 1 ^ (v >> 63))


def pbf():
    strings = _msg(*[(1, s.encode()) for s in ("", "place", "city", "name", "Norvale", "highway", "primary", "outer")])
    dense = _msg((1, _zz(1) + _zz(1) + _zz(1)), (8, _zz(471000000) + _zz(1000) + _zz(-1000)), (9, _zz(95000000) + _zz(0) + _zz(2000)), (10, b"\x01\x02\x03\x04\x00" + b"\x00\x00"))
    way = _msg((1, 10), (2, b"\x05\x03"), (3, b"\x06\x04"), (8, _zz(1) + _zz(1) + _zz(5)))
    rel = _msg((1, 20), (8, b"\x07"), (9, _zz(10)), (10, b"\x01"))
    block = _msg((1, strings), (2, _msg((2, dense))), (2, _msg((3, way))), (2, _msg((4, rel))))
    out = b""
    for kind, raw in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = _msg((2, len(raw)), (3, zlib.compress(raw)))
        head = _msg((1, kind), (3, len(blob)))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def test_pbf(spark, tmp_path):
    (tmp_path / "a.pbf").write_bytes(pbf())
    nodes, ways, refs, members = binary.pbf_tables(binary.read_pbf(spark, str(tmp_path / "a.pbf")))
    assert sorted((r.id, round(r.lon, 6), round(r.lat, 6)) for r in nodes.collect()) == [(1, 9.5, 47.1), (2, 9.5, 47.1001), (3, 9.5002, 47.1)]
    assert [(r.way_id, r.pos, r.node_id) for r in refs.orderBy("pos").collect()] == [(10, 0, 1), (10, 1, 2), (10, 2, 7)]
    assert [(r.rel_id, r.way_id, r.role) for r in members.collect()] == [(20, 10, "outer")]
    (place,) = files.osm_node_places(nodes).collect()
    assert (place.kind, place.gid, place.level) == ("city", "osm:node:1", 1)
    (street,) = files.osm_way_places(ways, refs, nodes).collect()  # a node is missing: the mean of the others
    assert street.gid == "osm:way:10" and street.lat == pytest.approx(47.10005)


def test_wikidata(spark, tmp_path):
    e = {"id": "Q1", "labels": {"de": {"language": "de", "value": "Wien"}, "fr": {"language": "fr", "value": "Vienne"}}, "aliases": {"en": [{"language": "en", "value": "V"}]}, "claims": {"P31": [{"mainsnak": {"datavalue": {"type": "x", "value": {"id": "Q515"}}}, "rank": "normal"}], "P1566": [{"mainsnak": {"datavalue": {"type": "string", "value": "99"}}, "rank": "deprecated"}, {"mainsnak": {"datavalue": {"type": "string", "value": "42"}}, "rank": "normal"}]}}
    p = write(tmp_path / "w.json", "[\n" + json.dumps(e) + ",\n" + json.dumps(e | {"id": "Q2"}) + ",\nbad\n]\n")
    got = files.wikidata(spark, p, spark.createDataFrame([("Q1",)], "qid string"))
    (r,) = got.collect()
    assert r.qid == "Q1" and r.geonames_id == "42" and r.p31_types == ["Q515"] and len(r.labels) == 2
    places = spark.createDataFrame([(1, "poi", "Q1", [("default", "Vienna")], [("a", "b")]), (2, "country", "Q1", [("de", "X")], []), (3, "poi", None, [("default", "N")], [])], "place_id long, kind string, wikidata string, names array<struct<lang:string,value:string>>, tags array<struct<key:string,value:string>>")
    once = joins.enrich_wikidata(places, got)
    rows = {r.place_id: r for r in once.collect()}
    assert rows[1].kind == "city" and [(n.lang, n.value) for n in rows[1]["names"]] == [("default", "Vienna"), ("de", "Wien"), ("fr", "Vienne"), ("en_alt", "V")]
    assert rows[2].kind == "country" and len(rows[2]["names"]) == 3 and rows[3].kind == "poi" and len(rows[3].tags) == 0
    assert sorted(once.collect(), key=str) == sorted(joins.enrich_wikidata(once, got).collect(), key=str)
    assert once.select(tag(once.tags, "geonames_id").alias("g")).where("g = '42'").count() == 2


def test_manifest_and_verify(spark, tmp_path):
    for i in range(2):
        spark.range(3 + i).coalesce(1).write.parquet(str(tmp_path / f"b/t{i}"))
    m = files.manifest(spark, str(tmp_path / "b"))
    expected = spark.createDataFrame(m.collect(), m.schema)
    assert files.verify(spark, str(tmp_path / "b"), expected).collect() == []
    victim = next((tmp_path / "b/t1").glob("*.parquet"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes() + b"x")
    assert [r.change for r in files.verify(spark, str(tmp_path / "b"), expected).collect()] == ["changed"]
