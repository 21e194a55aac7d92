"""Queries: readers and sinks, on files that the queries write from the test tables first."""

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import schema
from ..functions import udfs
from ..operators import joins, search
from ..scratch import scratch_path
from ..sources import binary, files, output
from . import views
from .base import query
from .q_scalar import TILE, TILE_SQL
from .views import view

#: A street address for each customer; every tenth has no number, every eleventh no street, every seventh bad coordinates.
ADDRESS = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE CAST(CAST((c_custkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS STRING) END AS lon, CASE WHEN c_custkey % 7 = 0 THEN '0' ELSE CAST(CAST((c_custkey * 104729) % 1700 AS DOUBLE) / 10 - 85 AS STRING) END AS lat, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE CAST(c_custkey % 200 + 1 AS STRING) END AS number, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat(c_mktsegment, ' road') END AS street FROM customer"
GOOD = "k % 7 <> 0 AND k % 10 <> 0 AND k % 11 <> 0"


def addresses(spark, d):
    return spark.sql(ADDRESS.replace("FROM customer", "FROM {customer}"), customer=view(spark, d, "customer"))


def name_of(rows):
    return F.get(rows["names"], F.lit(0))["value"]


def oa_file(spark, d):
    path = scratch_path(spark, "oa")
    rows = addresses(spark, d)
    rows.select(F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.col("number").alias("NUMBER"), F.col("street").alias("STREET"), F.lit("").alias("UNIT"), F.col("k").cast("string").alias("ID")).write.option("header", True).csv(path)
    return path


@query("S7_openaddresses", f"SELECT 'oa:address:' || k AS gid, number || ' ' || street AS name, round(lon::DOUBLE, 6) AS lon, round(lat::DOUBLE, 6) AS lat, 2 AS level FROM ({ADDRESS}) WHERE {GOOD}")
def s7(spark, d):
    rows = files.openaddresses(spark, oa_file(spark, d))
    return rows.select("gid", name_of(rows).alias("name"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "level")


COUNTED = "SELECT 'seen' AS counter, count(*) AS n FROM ({0}) HAVING count(*) > 0 UNION ALL SELECT CASE {1} ELSE 'emitted' END, count(*) FROM ({0}) GROUP BY 1"


@query("A10_import_counters", COUNTED.format(ADDRESS, "WHEN k % 7 = 0 THEN 'skipped_coordinates' WHEN k % 10 = 0 THEN 'skipped_number' WHEN k % 11 = 0 THEN 'skipped_street'"))
def a10(spark, d):
    return files.import_counters(spark, "openaddresses", oa_file(spark, d))


TOWN = "SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'T' ELSE 'P' END AS cls, CASE p_partkey % 4 WHEN 0 THEN 'PPLX' WHEN 1 THEN 'PPLH' ELSE 'PPL' END AS code, CAST((p_partkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((p_partkey * 104729) % 1700 AS DOUBLE) / 10 - 85 AS lat, p_size AS pop FROM part"


def town_file(spark, d):
    path = scratch_path(spark, "geonames")
    rows = spark.sql(TOWN.replace("FROM part", "FROM {part}"), part=view(spark, d, "part"))
    blank = F.lit("")
    cols = [F.col("k").cast("string"), F.col("name"), F.upper("name"), blank, F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("cls"), F.col("code"), F.lit("XX"), *[blank] * 5, F.col("pop").cast("string"), *[blank] * 4]
    rows.select(F.concat_ws("\t", *cols).alias("value")).write.text(path)
    return path


@query("S8_geonames", f"SELECT 'geonames:' || CASE code WHEN 'PPLX' THEN 'neighbourhood' ELSE 'locality' END || ':' || k AS gid, name, upper(name) AS ascii, CASE code WHEN 'PPLX' THEN 'neighborhood' ELSE 'city' END AS kind, pop::VARCHAR AS population FROM ({TOWN}) WHERE cls = 'P' AND code <> 'PPLH'")
def s8(spark, d):
    rows = files.geonames(spark, town_file(spark, d))
    return rows.select("gid", name_of(rows).alias("name"), F.get("names", F.lit(1))["value"].alias("ascii"), "kind", schema.tag(F.col("tags"), "population").alias("population"))


@query("F6_skip_counters", COUNTED.format(TOWN, "WHEN cls <> 'P' THEN 'skipped_class' WHEN code = 'PPLH' THEN 'skipped_code'"))
def f6(spark, d):
    return files.import_counters(spark, "geonames", town_file(spark, d))


@query("S9_postcodes", "SELECT 'geonames:postalcode:XX-' || (10000 + s_suppkey) AS gid, (10000 + s_suppkey)::VARCHAR AS code, (10000 + s_suppkey) || ' ' || s_name AS long_name, 1 AS level FROM supplier WHERE s_suppkey % 6 <> 0")
def s9(spark, d):
    path, blank = scratch_path(spark, "postcodes"), F.lit("")
    code = F.when(F.col("s_suppkey") % 6 != 0, (F.col("s_suppkey") + 10000).cast("string")).otherwise("")
    view(spark, d, "supplier").select(F.concat_ws("\t", F.lit("XX"), code, "s_name", *[blank] * 6, F.lit("47.5"), F.lit("9.5"), F.lit("4")).alias("value")).write.text(path)
    rows = files.geonames_postcodes(spark, path)
    return rows.select("gid", name_of(rows).alias("code"), F.get("names", F.lit(1))["value"].alias("long_name"), "level")


@query("S10_generic_csv", "SELECT s_suppkey AS k, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'street' ELSE 'poi' END AS kind, (s_suppkey * 2)::VARCHAR AS population, 'c' || s_nationkey AS colour FROM supplier WHERE s_suppkey % 8 <> 0")
def s10(spark, d):
    path = scratch_path(spark, "generic")
    rows = view(spark, d, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "town").when(F.col("s_suppkey") % 3 == 1, "Road").otherwise("kiosk")
    rows = rows.select(F.lit("9.5").alias("Longitude"), F.when(F.col("s_suppkey") % 8 != 0, "47.5").alias("y"), F.col("s_name").alias("Name"), kind.alias("kind"), (F.col("s_suppkey") * 2).cast("string").alias("pop"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("colour"), F.col("s_suppkey").alias("number"))
    rows.write.option("header", True).csv(path)
    got = files.generic_csv(spark, path)
    tag = lambda k: schema.tag(F.col("tags"), k)
    return got.select(tag("number").cast("long").alias("k"), name_of(got).alias("name"), "kind", tag("population").alias("population"), tag("colour").alias("colour"))


@query("S11_geojson", "SELECT 'generic:venue:' || s_suppkey AS gid, s_name AS name, round((s_suppkey % 180)::DOUBLE, 6) AS lon, round((s_suppkey % 85)::DOUBLE, 6) AS lat, 'n' || s_suppkey AS german FROM supplier WHERE s_suppkey % 4 <> 3")
def s11(spark, d):
    path = scratch_path(spark, "geojson")
    k = F.col("s_suppkey")
    xy = F.array((k % 180).cast("double"), (k % 85).cast("double"))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), xy.alias("coordinates")))
    area = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(xy, F.array(F.lit(1.0), F.lit(2.0)), xy)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(xy, xy).alias("coordinates")))
    shape = F.when(k % 4 == 3, line).when(k % 4 == 2, area).otherwise(point)
    props = F.to_json(F.struct(F.col("s_name").alias("name"), F.concat(F.lit("n"), k.cast("string")).alias("name:de")))
    feature = F.concat(F.lit('{"type":"Feature","id":"'), k.cast("string"), F.lit('","geometry":'), shape, F.lit(',"properties":'), props, F.lit("}"))
    docs = view(spark, d, "supplier").select(F.floor(k / 500).alias("doc"), feature.alias("f")).groupBy("doc").agg(F.concat_ws(",", F.collect_list("f")).alias("fs"))  # 500 at most
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "fs", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = files.geojson(spark, path)
    return rows.select("gid", name_of(rows).alias("name"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.get("names", F.lit(1))["value"].alias("german"))


@F.pandas_udf(BinaryType())
def wkb_of_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


@F.pandas_udf(BinaryType())
def wkb_of_box(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIII10d", 1, 3, 1, 5, a, b, c, b, c, e, a, e, a, b) for a, b, c, e in zip(x0, y0, x1, y1, strict=True)])


@query("S12_geoparquet", "SELECT 'generic:venue:' || place_id AS gid, name, round(lon, 6) AS lon, round(lat, 6) AS lat, population::VARCHAR AS population FROM v_places WHERE NOT (lon = 0 AND lat = 0)")
def s12(spark, d):
    path = scratch_path(spark, "geoparquet")
    view(spark, d, "v_places").select(F.col("place_id").cast("string").alias("key"), F.col("name").alias("label"), wkb_of_point("lon", "lat").alias("geometry"), "population").write.parquet(path)
    rows = files.geoparquet(spark, path, {"id": "key", "name": "label"}, keep=["population"])
    return rows.select("gid", name_of(rows).alias("name"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), schema.tag(F.col("tags"), "population").alias("population"))


@query("N35_wkb_polygons", "SELECT id, round(x0, 6) AS min_x, round(y1, 6) AS max_y, 5 AS vertices FROM v_buildings")
def n35(spark, d):
    ring = F.get(F.get(udfs.wkb_polygons(wkb_of_box("x0", "y0", "x1", "y1")), F.lit(0)), F.lit(0))
    rows = view(spark, d, "v_buildings").select("id", ring.alias("ring"))
    return rows.select("id", F.round(F.array_min(F.transform("ring", lambda v: v["x"])), 6).alias("min_x"), F.round(F.array_max(F.transform("ring", lambda v: v["y"])), 6).alias("max_y"), F.size("ring").alias("vertices"))


@query("S13_overture", f"SELECT 'overture:place:' || s_suppkey AS gid, s_name AS name, 'poi' AS kind FROM supplier UNION ALL SELECT 'overture:address:' || k, number || ' ' || street, 'address' FROM ({ADDRESS}) WHERE k % 7 <> 0 AND k % 10 <> 0")
def s13(spark, d):
    a, b = scratch_path(spark, "overture"), scratch_path(spark, "overture")
    view(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("s_name").alias("primary")).alias("names"), wkb_of_point(F.lit(9.5), F.lit(47.5)).alias("geometry")).write.parquet(a)
    addresses(spark, d).select(F.col("k").cast("string").alias("id"), "number", "street", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).write.parquet(b)
    rows = files.overture(spark, a, "places").unionByName(files.overture(spark, b, "addresses"))
    return rows.select("gid", F.trim(name_of(rows)).alias("name"), "kind").withColumn("name", F.when(F.col("kind") == "address", F.regexp_replace("name", "^([0-9]+)$", "$1 ")).otherwise(F.col("name")))


@query("S14_footprints", "SELECT id, round((x0 + x1) / 2, 6) AS lon, round(y0, 6) AS min_y, round(height, 4) AS height FROM v_buildings")
def s14(spark, d):
    path = scratch_path(spark, "footprints")
    view(spark, d, "v_buildings").select("id", wkb_of_box("x0", "y0", "x1", "y1").alias("geometry"), "height").write.parquet(path)
    return files.buildings(spark, path).select("id", F.round("lon", 6).alias("lon"), F.round("min_y", 6).alias("min_y"), F.round("height", 4).alias("height"))


def wikidata_file(spark, d):
    path = scratch_path(spark, "wikidata")
    k = F.col("n_nationkey").cast("string")
    line = F.concat(F.lit('{"id":"Q'), k, F.lit('","labels":{"xx":{"language":"xx","value":"'), F.col("n_name"), F.lit('"}},"aliases":{"yy":[{"language":"yy","value":"y'), k, F.lit('"}]},"claims":{"P31":[{"mainsnak":{"datavalue":{"type":"t","value":{"id":"'), F.when(F.col("n_nationkey") % 2 == 0, "Q515").otherwise("Q1"), F.lit('"}}},"rank":"normal"}],"P1566":[{"mainsnak":{"datavalue":{"type":"string","value":"'), k, F.lit('"}},"rank":"normal"}]}},'))
    view(spark, d, "nation").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("S15_wikidata", "SELECT 'Q' || n_nationkey AS qid, n_name AS label, 'y' || n_nationkey AS alias, n_nationkey::VARCHAR AS geonames_id, CASE n_nationkey % 2 WHEN 0 THEN 'Q515' ELSE 'Q1' END AS type FROM nation WHERE n_nationkey % 3 <> 0")
def s15(spark, d):
    wanted = view(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("qid"))
    rows = files.wikidata(spark, wikidata_file(spark, d), wanted)
    return rows.select("qid", F.get("labels", F.lit(0))["value"].alias("label"), F.get("aliases", F.lit(0))["value"].alias("alias"), "geonames_id", F.get("p31_types", F.lit(0)).alias("type"))


@query("J10_wikidata_enrich", "SELECT place_id, CASE WHEN kind = 'poi' AND nation_id % 2 = 0 THEN 'city' ELSE kind END AS kind, CASE WHEN nation_id IS NULL THEN 1 ELSE 3 END AS n_names, CASE WHEN nation_id IS NOT NULL THEN (nation_id - 1000)::VARCHAR END AS geonames_id FROM v_places")
def j10(spark, d):
    q = F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))
    entities = files.wikidata(spark, wikidata_file(spark, d), view(spark, d, "nation").select(q.alias("qid")))
    ids = view(spark, d, "v_places").select("place_id", F.concat(F.lit("Q"), (F.col("nation_id") - 1000).cast("string")).alias("wikidata"))
    rows = joins.enrich_wikidata(views.places(spark, d).join(ids, "place_id"), entities)
    return rows.select("place_id", "kind", F.size("names").alias("n_names"), schema.tag(F.col("tags"), "geonames_id").alias("geonames_id"))


@query("S16_change_files", "SELECT seq AS version, action, kind, id, round(lon, 6) AS lon, tag FROM v_ops")
def s16(spark, d):
    op = F.concat(F.lit("<"), F.col("action"), F.lit("><"), F.col("kind"), F.lit(' id="'), F.col("id").cast("string"), F.lit('" version="'), F.col("version").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('" lat="'), F.col("lat").cast("string"), F.lit('"><tag k="'), F.col("tag"), F.lit('" v="v"/></'), F.col("kind"), F.lit("></"), F.col("action"), F.lit(">"))
    ops = view(spark, d, "v_ops").select(F.floor(F.col("seq") / 500).alias("file"), op.alias("op")).groupBy("file").agg(F.concat_ws("", F.collect_list("op")).alias("ops"))  # 500 at most
    made = ops.select(F.format_string("x/%09d.osc", "file").alias("path"), F.concat(F.lit("<osmChange>"), "ops", F.lit("</osmChange>")).cast("binary").alias("content"))
    return binary.osc_operations(made).select("version", "action", "kind", "id", F.round("lon", 6).alias("lon"), F.get("tags", F.lit(0))["key"].alias("tag"))


@query("S1_osm_node_places", "SELECT 'osm:node:' || s_suppkey AS gid, CASE s_suppkey % 3 WHEN 0 THEN 'city' ELSE 'poi' END AS kind, s_name AS name FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 5 <> 0")
def s1(spark, d):
    k = F.col("s_suppkey")
    pair = lambda a, b: F.struct(F.lit(a).alias("key"), b.alias("value"))
    kind = F.when(k % 3 == 0, F.array(pair("place", F.lit("town")))).when(k % 3 == 1, F.array(pair("amenity", F.lit("bar")))).otherwise(F.array(pair("power", F.lit("tower"))))
    name = F.when(k % 5 != 0, F.array(pair("name", F.col("s_name")))).otherwise(F.array().cast(schema.TAGS))
    rows = files.osm_node_places(view(spark, d, "supplier").select(k.alias("id"), F.lit(9.5).alias("lon"), F.lit(47.5).alias("lat"), F.concat(kind, name).alias("tags")))
    return rows.select("gid", "kind", name_of(rows).alias("name"))


def relation_parts(spark, d):
    """Members, references and nodes of ``v_box``: four ways an outer ring, every other one the wrong way round; an inner one for the shape with a hole."""
    box = view(spark, d, "v_box").where("shape <> 'L'")
    corner = lambda i, x, y: F.struct(F.lit(i).alias("c"), x.alias("lon"), y.alias("lat"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    qx, qy = (x1 - x0) / 4, (y1 - y0) / 4
    outer = F.array(corner(0, x0, y0), corner(1, x1, y0), corner(2, x1, y1), corner(3, x0, y1))
    inner = F.array(corner(4, x0 + qx, y0 + qy), corner(5, x1 - qx, y0 + qy), corner(6, x1 - qx, y1 - qy), corner(7, x0 + qx, y1 - qy))
    corners = F.when(F.col("shape") == "O", F.concat(outer, inner)).otherwise(outer)
    each = box.select("place_id", F.inline(corners))
    nodes = each.select((F.col("place_id") * 10 + F.col("c")).alias("id"), "lon", "lat")
    ways = each.select("place_id", "c", (F.col("place_id") * 10 + F.col("c")).alias("way_id"), (F.col("place_id") * 10 + F.when(F.col("c") % 4 == 3, F.col("c") - 3).otherwise(F.col("c") + 1)).alias("to"))
    ends = F.when(F.col("c") % 2 == 0, F.array("way_id", "to")).otherwise(F.array("to", "way_id"))
    refs = ways.select("way_id", F.posexplode(ends).alias("pos", "node_id"))
    members = ways.select(F.col("place_id").alias("rel_id"), "way_id", F.when(F.col("c") > 3, "inner").otherwise("outer").alias("role"), F.col("c").alias("member_pos"))
    return members, refs, nodes


@query("S3_relation_polygons", "SELECT place_id AS rel_id, CASE shape WHEN 'O' THEN 2 ELSE 1 END AS rings, 5 AS vertices, round((x1 - x0) * (y1 - y0), 6) AS area, CASE shape WHEN 'O' THEN round(-(x1 - x0) * (y1 - y0) / 4, 6) END AS hole FROM v_box WHERE shape <> 'L'")
def s3(spark, d):
    from ..functions import geo

    rows = joins.assemble_relations(*relation_parts(spark, d)).withColumn("part", F.get("polygon", F.lit(0)))
    rows = rows.withColumns({"ring": F.get("part", F.lit(0)), "inner": F.get("part", F.lit(1))})
    return rows.select("rel_id", F.size("part").alias("rings"), F.size("ring").alias("vertices"), F.round(F.expr(geo.signed_area("ring")), 6).alias("area"), F.when(F.col("inner").isNotNull(), F.round(F.expr(geo.signed_area("inner")), 6)).alias("hole"))


@query("R10_simplified", "SELECT id, 5 AS vertices, 5 AS kept FROM v_buildings WHERE shape = 'B' UNION ALL SELECT id, 7, 7 FROM v_buildings WHERE shape = 'L'")
def r10(spark, d):
    rows = views.buildings(spark, d).select("id", "outer_ring", F.size("outer_ring").alias("vertices"))
    middle = lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    doubled = F.flatten(F.transform("outer_ring", lambda v, i: F.when(i + 1 < F.size("outer_ring"), F.array(v, middle(v, F.get("outer_ring", i + 1)))).otherwise(F.array(v))))
    return rows.select("id", "vertices", F.size(F.get(F.get(udfs.simplify(0.001)(F.array(F.array(doubled)).cast(schema.POLYGON)), F.lit(0)), F.lit(0))).alias("kept"))


@query("J5_gazetteer_records", "SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN 'city' WHEN 1 THEN 'county' ELSE 'region' END AS kind, n_name || ',n' || n_nationkey AS names FROM nation WHERE n_nationkey % 5 <> 0")
def j5(spark, d):
    k = F.col("n_nationkey")
    n = view(spark, d, "nation")
    placetype = F.when(k % 3 == 0, "locality").when(k % 3 == 1, "localadmin").otherwise("macroregion")
    spr = n.select(k.cast("long").alias("id"), F.col("n_name").alias("name"), placetype.alias("placetype"), F.lit(47.5).alias("latitude"), F.lit(9.5).alias("longitude"), F.when(k % 5 == 0, 0).otherwise(1).alias("is_current"), F.lit(0).alias("is_deprecated"), F.lit(0).alias("is_ceased"))
    own = n.select(k.cast("long").alias("id"), F.lit("xxx").alias("language"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.lit("preferred").alias("privateuse"))
    other = own.withColumns({"name": F.lit("no"), "privateuse": F.lit("variant")})
    return joins.wof_records(spr, own.unionByName(other)).select("id", "kind", F.array_join(F.transform("names", lambda x: x["value"]), ",").alias("names"))


@query("K1_written_places", "SELECT place_id, level, kind, name FROM v_places")
def k1(spark, d):
    path = scratch_path(spark, "bundle")
    files.write_places(views.places(spark, d), path)
    rows = spark.read.parquet(path)
    return rows.select("place_id", "level", "kind", name_of(rows).alias("name"))


@query("B1_verify", "SELECT 'unchanged' AS state, 0::BIGINT AS n UNION ALL SELECT 'against another bundle', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM nation")
def b1(spark, d):
    a, b = scratch_path(spark, "bundle"), scratch_path(spark, "bundle")
    files.write_places(views.places(spark, d), a)
    files.write_places(views.places(spark, d).where("kind <> 'country'"), b)
    known = files.manifest(spark, a)
    return files.verify(spark, a, known).agg(F.lit("unchanged").alias("state"), F.count("*").alias("n")).unionByName(files.verify(spark, b, known).agg(F.lit("against another bundle").alias("state"), F.when(F.count("*") > 0, 1).otherwise(0).cast("long").alias("n")))


@query("T6_apply_diff", "SELECT s_suppkey AS path, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END AS hash FROM supplier WHERE s_suppkey % 7 <> 0")
def t6(spark, d):
    s = view(spark, d, "supplier")
    old = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), F.col("s_acctbal").alias("hash"))
    new = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("hash"))
    return joins.apply_diff(old, new, joins.diff_files(old, new))


@query("K10_lines", """SELECT '{"qid":' || qid || ',"rank":' || rank || ',"id":' || id || '}' AS value FROM (SELECT l_orderkey AS qid, l_linenumber AS rank, l_partkey AS id FROM lineitem)""")
def k10(spark, d):
    hits = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    return output.ndjson(hits, ["qid", "rank", "id"])


@query("K10_envelopes", """SELECT qid, '{"results":[' || string_agg('{"id":' || id || '}', ',' ORDER BY rank, id) || ']}' AS body FROM (SELECT l_orderkey AS qid, l_linenumber AS rank, l_partkey AS id FROM lineitem) GROUP BY 1""")
def k10e(spark, d):
    hits = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    return output.envelopes(hits, ["id"])


@query("X0_blank_queries", "SELECT 0::BIGINT AS n")
def x0(spark, d):
    index = search.build_index(views.places(spark, d), plain=True)
    blank = view(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(" \t ").alias("q"))
    return search.search(blank, index, plain=True).agg(F.count("*").alias("n"))


@query("K3_point_tiles", f"SELECT place_id, level, {TILE_SQL} AS tile_id FROM v_places")
def k3(spark, d):
    path = scratch_path(spark, "points")
    files.write_tiled(view(spark, d, "v_places"), path)
    return spark.read.parquet(path).select("place_id", "level", "tile_id")


@query("K4_building_tiles", f"SELECT id, {TILE[2]} AS tile_id FROM (SELECT id, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM v_buildings)")
def k4(spark, d):
    path = scratch_path(spark, "buildings")
    files.write_tiled(views.buildings(spark, d), path, 2)
    return spark.read.parquet(path).select("id", "tile_id")


@query("S18_tile_reader", f"SELECT place_id FROM v_places WHERE level = 2 AND {TILE_SQL} IN (SELECT {TILE_SQL} FROM v_places WHERE kind = 'poi')")
def s18(spark, d):
    from ..functions import ids

    path = scratch_path(spark, "points")
    files.write_tiled(view(spark, d, "v_places"), path)
    asked = view(spark, d, "v_places").where("kind = 'poi'").select(ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")).alias("tile_id")).distinct()
    return spark.read.parquet(path).where("level = 2").join(asked, "tile_id", "left_semi").select("place_id")


@query("B3_inspect", f"SELECT level, {TILE_SQL} AS tile_id, kind, count(*) AS n, min(place_id) AS min_id, max(place_id) AS max_id FROM v_places GROUP BY 1, 2, 3")
def b3(spark, d):
    path = scratch_path(spark, "points")
    files.write_tiled(view(spark, d, "v_places"), path)
    return files.inspect(spark.read.parquet(path))


@query("N26_packed_vectors", "SELECT vec_id, 256 AS bytes, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS total FROM embeddings")
def n26(spark, d):
    rows = view(spark, d, "embeddings").select("vec_id", udfs.pack_vectors("embedding").alias("packed"))
    rows = rows.select("vec_id", F.octet_length("packed").alias("bytes"), udfs.unpack_vectors("packed").alias("v"))
    return rows.select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("F1_layer_words", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'postcode' WHEN 1 THEN 'poi' WHEN 2 THEN 'city' ELSE 'street' END AS layer FROM part")
def f1(spark, d):
    k = F.col("p_partkey") % 4
    word = F.when(k == 0, "ZIP").when(k == 1, "venue").when(k == 2, "locality").otherwise("street")
    return view(spark, d, "part").select("p_partkey", search.LAYER(word).alias("layer"))


@query("W9_ordered_lookup", "SELECT pos, place_id FROM (SELECT min(s_suppkey) AS pos, 1000000000 + s_suppkey % 50 AS place_id FROM supplier GROUP BY s_suppkey % 50) WHERE place_id IN (SELECT place_id FROM v_places)")
def w9(spark, d):
    index = search.build_index(views.places(spark, d), plain=True)
    wanted = view(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), (F.lit(1000000000) + F.col("s_suppkey") % 50).cast("string").alias("token"))
    return search.lookup(wanted, index).select("pos", "place_id")


GRAMS = "SELECT DISTINCT {0} AS name, unnest(list_distinct([substring(chr(1) || p || chr(1), i::INT, 3) FOR i IN range(1, length(p) + 1)])) AS t FROM (SELECT {0}, lower(trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))) AS p FROM part)"


@query("U3_shared_trigrams", f"SELECT a.name AS a, b.name AS b, count(*) AS shared FROM ({GRAMS.format('p_name')}) a JOIN ({GRAMS.format('p_type')}) b USING (t) GROUP BY 1, 2")
def u3(spark, d):
    from ..functions import text

    grams = lambda c: view(spark, d, "part").select(F.col(c).alias("name")).distinct().select("name", F.explode(text.trigrams(F.col("name"))).alias("t"))
    return grams("p_name").withColumnRenamed("name", "a").join(grams("p_type").withColumnRenamed("name", "b"), "t").groupBy("a", "b").agg(F.count("*").alias("shared"))
