"""Queries: spatial joins, dedup, ways, chains, diffs and incremental updates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import geo
from ..functions.text import confidence
from ..operators import dedup, joins, spatial
from . import views
from .base import query
from .q_scalar import TILE, TILE_SQL
from .views import INSIDE, view

BOX_AT = f"SELECT q.qid, b.place_id, b.kind, b.name, round((x1 - x0) * (y1 - y0), 6) AS area FROM (SELECT qid, lon AS px, lat AS py FROM v_points) q JOIN v_box b ON {INSIDE}"


@query("J6_point_in_polygon", BOX_AT)
def j6(spark, d):
    return spatial.point_in_polygon(view(spark, d, "v_points"), views.admin(spark, d)).select("qid", "place_id", "kind", "name", F.round("area", 6).alias("area"))


@query("R1_finest_first", f"SELECT qid, place_id, row_number() OVER (PARTITION BY qid ORDER BY area, place_id)::INT AS rank FROM ({BOX_AT})")
def r1(spark, d):
    return spatial.finest_first(spatial.point_in_polygon(view(spark, d, "v_points"), views.admin(spark, d))).select("qid", "place_id", "rank")


@query("J7_enrich_places", f"SELECT p.place_id, coalesce((SELECT string_agg(b.place_id::VARCHAR, ',' ORDER BY CASE b.kind WHEN 'country' THEN 0 ELSE 1 END, (b.x1 - b.x0) * (b.y1 - b.y0) DESC, b.place_id) FROM (SELECT *, p.lon AS px, p.lat AS py FROM v_box) b WHERE {INSIDE} AND b.place_id <> p.place_id AND b.kind <> p.kind), '') AS path FROM v_places p")
def j7(spark, d):
    p = views.places(spark, d).withColumn("admin_path", F.array().cast("array<long>"))
    return spatial.enrich_places(p, views.admin(spark, d)).select("place_id", F.array_join(F.transform("admin_path", lambda x: x.cast("string")), ",").alias("path"))


@query("J8_enrich_admin", f"SELECT a.place_id, coalesce((SELECT string_agg(b.place_id::VARCHAR, ',' ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0) DESC, b.place_id) FROM (SELECT *, (a.x0 + a.x1) / 2 AS px, (a.y0 + a.y1) / 2 AS py FROM v_box WHERE kind = 'country') b WHERE a.kind = 'region' AND {INSIDE}), '') AS path FROM v_box a")
def j8(spark, d):
    return spatial.enrich_admin(views.admin(spark, d)).select("place_id", F.array_join(F.transform("admin_path", lambda x: x.cast("string")), ",").alias("path"))


KNN = "SELECT * FROM (SELECT q.qid, p.place_id, row_number() OVER (PARTITION BY q.qid ORDER BY (q.lon - p.lon) * (q.lon - p.lon) + (q.lat - p.lat) * (q.lat - p.lat), p.place_id)::INT AS rank FROM v_points q, {0} p) WHERE rank <= {1}"


@query("R2_nearest", KNN.format("v_places", 5))
def r2(spark, d):
    return spatial.nearest(view(spark, d, "v_points"), view(spark, d, "v_places"), 5).select("qid", "place_id", "rank")


@query("R3_nearest_filtered", KNN.format("(SELECT * FROM v_places WHERE kind = 'address' AND population % 2 = 0)", 3))
def r3(spark, d):
    return spatial.nearest(view(spark, d, "v_points"), view(spark, d, "v_places").where("kind = 'address' AND population % 2 = 0"), 3).select("qid", "place_id", "rank")


KM = "2 * 6371.0088 * asin(least(sqrt(pow(sin((radians({b}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({b})) * pow(sin(radians({a} - lon) / 2), 2)), 1))"


@query(
    "R4_reverse",
    f"""WITH hit AS (SELECT q.qid, q.px AS lon, q.py AS lat, b.place_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, row_number() OVER (PARTITION BY q.qid ORDER BY round((x1 - x0) * (y1 - y0), 9), b.place_id) AS rank FROM (SELECT qid, lon AS px, lat AS py FROM v_points) q JOIN v_box b ON {INSIDE}),
    near AS (SELECT q.qid, q.lon, q.lat, p.place_id, p.lon AS cx, p.lat AS cy, row_number() OVER (PARTITION BY q.qid ORDER BY (q.lon - p.lon) * (q.lon - p.lon) + (q.lat - p.lat) * (q.lat - p.lat), p.place_id) AS rank FROM v_points q, (SELECT * FROM v_places WHERE kind = 'address') p WHERE q.qid NOT IN (SELECT qid FROM hit))
    SELECT qid, 'pip' AS source, rank::INT AS rank, place_id, round({KM.format(a='cx', b='cy')}, 5) AS distance_km FROM hit
    UNION ALL SELECT qid, 'nearest', rank::INT, place_id, round({KM.format(a='cx', b='cy')}, 5) FROM near WHERE rank <= 2""",
)
def r4(spark, d):
    rows = spatial.reverse(view(spark, d, "v_points"), views.admin(spark, d), view(spark, d, "v_places").where("kind = 'address'"), near=2)
    return rows.withColumn("distance_km", F.round("distance_km", 5))


@query("R5_reverse_full", f"SELECT qid, 'admin' AS class, row_number() OVER (PARTITION BY qid ORDER BY area, place_id)::INT AS rank, place_id FROM ({BOX_AT}) UNION ALL SELECT qid, 'poi', rank, place_id FROM ({KNN.format(chr(40) + 'SELECT * FROM v_places WHERE kind = ' + chr(39) + 'poi' + chr(39) + chr(41), 1)}) UNION ALL SELECT qid, 'address', rank, place_id FROM ({KNN.format(chr(40) + 'SELECT * FROM v_places WHERE kind = ' + chr(39) + 'address' + chr(39) + chr(41), 1)})")
def r5(spark, d):
    return spatial.reverse_full(view(spark, d, "v_points"), views.admin(spark, d), view(spark, d, "v_places"), schema.reverse_class(F.col("kind")))


BLD = "SELECT q.qid, b.id, row_number() OVER (PARTITION BY q.qid ORDER BY (x1 - x0) * (y1 - y0), b.id)::INT AS rank, round(b.height, 2) AS height FROM (SELECT {1} AS qid, lon AS px, lat AS py FROM {2}) q JOIN v_buildings b ON {0}"
VERTEX = "((px = x0 AND py = y0) OR (px = x1 AND py = y0) OR (px = x0 AND py = y1) OR (shape = 'B' AND px = x1 AND py = y1) OR (shape = 'L' AND ((px = x1 AND py = (y0 + y1) / 2) OR (px = (x0 + x1) / 2 AND py = (y0 + y1) / 2) OR (px = (x0 + x1) / 2 AND py = y1))))"


@query("R6_buildings_strict", BLD.format(f"({INSIDE} OR {VERTEX})", "qid", "v_points"))
def r6(spark, d):
    return spatial.buildings_at(view(spark, d, "v_points"), views.buildings(spark, d)).select("qid", "id", "rank", F.round("height", 2).alias("height"))


@query("R6_buildings_bbox", BLD.format("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1", "qid", "v_points"))
def r6b(spark, d):
    return spatial.buildings_at(view(spark, d, "v_points"), views.buildings(spark, d), strict=False).select("qid", "id", "rank", F.round("height", 2).alias("height"))


@query("R7_nearest_buildings", "SELECT * FROM (SELECT q.qid, b.id, row_number() OVER (PARTITION BY q.qid ORDER BY (q.lon - cx) * (q.lon - cx) + (q.lat - cy) * (q.lat - cy), k)::INT AS rank FROM v_points q, (SELECT id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, substring(id, 2)::BIGINT AS k FROM v_buildings) b) WHERE rank <= 3")
def r7(spark, d):
    b = views.buildings(spark, d).withColumn("place_id", F.substring("id", 2, 20).cast("long"))
    return spatial.nearest(view(spark, d, "v_points"), b, 3).select("qid", F.concat(F.lit("b"), F.col("place_id").cast("string")).alias("id"), "rank")


@query("R8_pelias_reverse", f"SELECT qid, place_id, 0.5::DOUBLE AS confidence FROM ({BOX_AT})")
def r8(spark, d):
    return spatial.point_in_polygon(view(spark, d, "v_points"), views.admin(spark, d)).select("qid", "place_id", confidence(F.lit(1.0)).alias("confidence"))


@query("J9_attach_buildings", f"SELECT qid AS place_id, id AS building_id, printf('%.1f', height + 1e-9) AS building_height FROM ({BLD.format(f'({INSIDE} OR {VERTEX})', 'place_id', 'v_places')}) WHERE rank = 1")
def j9(spark, d):
    p = views.places(spark, d)
    b = views.buildings(spark, d).withColumn("height", F.round("height", 2))
    rows = spatial.attach_buildings(spatial.attach_buildings(p, b), b)
    return rows.select("place_id", schema.tag(F.col("tags"), "building_id").alias("building_id"), schema.tag(F.col("tags"), "building_height").alias("building_height")).where("building_id IS NOT NULL")


@query("R9_extract", f"SELECT place_id FROM (SELECT *, {TILE_SQL} AS t FROM v_places) WHERE CASE level WHEN 0 THEN (t % 90) * 4 - 176 >= 0 AND (t % 90) * 4 - 180 <= 60 AND (t // 90) * 4 - 86 >= 0 AND (t // 90) * 4 - 90 <= 40 ELSE (t % 1440) * 0.25 - 179.75 >= 0 AND (t % 1440) * 0.25 - 180 <= 60 AND (t // 1440) * 0.25 - 89.75 >= 0 AND (t // 1440) * 0.25 - 90 <= 40 END")
def r9(spark, d):
    return joins.extract(view(spark, d, "v_places"), 0.0, 0.0, 60.0, 40.0).select("place_id")


@query("K2_admin_tiles", "SELECT place_id, (r * 90 + c)::INT AS tile_id FROM v_box, range(0, 45) rr(r), range(0, 90) cc(c) WHERE c BETWEEN least(floor((x0 + 180) / 4), 89) AND least(floor((x1 + 180) / 4), 89) AND r BETWEEN floor((y0 + 90) / 4) AND floor((y1 + 90) / 4)")
def k2(spark, d):
    return spatial.admin_tiles(views.admin(spark, d)).select("place_id", "tile_id")


def _dups(spark, d):
    v = view(spark, d, "v_dups")
    return v.withColumns({"names": F.array(F.struct(F.lit("default").alias("lang"), F.col("name").alias("value"))), "admin_path": F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda x: x.cast("long"))})


# The shifted copies lie within 150 m of their originals and of no other place.
@query("A1_dedup_places", "SELECT input_ord FROM v_dups a WHERE CASE WHEN input_ord % 2 = 1 THEN (SELECT o.depth FROM v_dups o WHERE o.input_ord = a.input_ord - 1) < 2 AND abs(lat) >= 0 ELSE NOT EXISTS (SELECT 1 FROM v_dups c WHERE c.input_ord = a.input_ord + 1) OR depth >= 2 END")
def a1(spark, d):
    return dedup.dedupe_places(_dups(spark, d)).select("input_ord")


@query("A1_dedup_priority", "SELECT input_ord FROM v_dups a WHERE input_ord % 2 = 1 OR NOT EXISTS (SELECT 1 FROM v_dups c WHERE c.input_ord = a.input_ord + 1)")
def a1p(spark, d):
    return dedup.dedupe_places(_dups(spark, d), ["overture", "osm"]).select("input_ord")


@query("A2_dedup_admin", "SELECT input_ord FROM (SELECT *, row_number() OVER (PARTITION BY kind, round(lon * 1000)::INT, round(lat * 1000)::INT ORDER BY depth DESC, strlen(name) DESC, input_ord) AS n FROM v_dups) WHERE n = 1")
def a2(spark, d):
    return dedup.dedupe_admin(_dups(spark, d)).select("input_ord")


@query("U1_union_sources", "SELECT 'oa' AS source, count(*) AS n FROM customer UNION ALL SELECT 'osm', count(*) FROM supplier UNION ALL SELECT 'wof', count(*) FROM nation")
def u1(spark, d):
    v = view(spark, d, "v_places").drop("source")
    rows = dedup.union_sources(wof=v.where("kind = 'country'"), osm=v.where("kind = 'poi'"), oa=v.where("kind = 'address'"))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("S2_way_centroids", "SELECT way_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n FROM v_ways JOIN v_nodes ON node_id = id GROUP BY 1")
def s2(spark, d):
    return joins.way_centroids(view(spark, d, "v_ways"), view(spark, d, "v_nodes")).select("way_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n")


@query("S5_node_lookup", "SELECT way_id, pos, lon, lat FROM v_ways JOIN v_nodes ON node_id = id")
def s5(spark, d):
    return joins.node_coords(view(spark, d, "v_ways"), view(spark, d, "v_nodes")).select("way_id", "pos", "lon", "lat")


@query("J2_referenced_ways", "SELECT DISTINCT way_id FROM v_ways WHERE way_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j2(spark, d):
    wanted = view(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("way_id"))
    return view(spark, d, "v_ways").join(wanted, "way_id", "left_semi").select("way_id").distinct()


@query("W11_arc_length", "SELECT way_id, pos, round(sum(step) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 6) AS cum FROM (SELECT way_id, pos, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0) AS step FROM (SELECT way_id, pos, lon, lat FROM (SELECT way_id, pos, any_value(node_id) AS node_id, count(*) AS c FROM v_ways GROUP BY 1, 2) JOIN v_nodes ON node_id = id WHERE c = 1) WINDOW w AS (PARTITION BY way_id ORDER BY pos))")
def w11(spark, d):
    one = view(spark, d, "v_ways").groupBy("way_id", "pos").agg(F.first("node_id").alias("node_id"), F.count("*").alias("c")).where("c = 1")
    return joins.arc_lengths(joins.node_coords(one, view(spark, d, "v_nodes"))).select("way_id", "pos", F.round("cum", 6).alias("cum"))


# Two-node ways along a meridian: numbers lie at equal steps.
@query("S4_interpolation", "SELECT way_id, number, 0.0::DOUBLE AS lon, round((number - lo) / (hi - lo)::DOUBLE, 6) AS lat FROM (SELECT s_suppkey AS way_id, 1 AS lo, 1 + 2 * (2 + s_suppkey % 4) AS hi, unnest(range(3, 1 + 2 * (2 + s_suppkey % 4), 2)) AS number FROM supplier)")
def s4(spark, d):
    s = view(spark, d, "supplier")
    ways = s.select(F.col("s_suppkey").alias("way_id"), F.lit("odd").alias("kind"), F.lit("x").alias("street"))
    refs = s.select(F.col("s_suppkey").alias("way_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("node_id", F.col("way_id") * 2 + F.col("pos"))
    nodes = refs.select(F.col("node_id").alias("id"), F.lit(0.0).alias("lon"), F.col("pos").cast("double").alias("lat"))
    numbers = refs.select("node_id", F.when(F.col("pos") == 0, "1").otherwise((1 + 2 * (2 + F.col("way_id") % 4)).cast("string")).alias("number"), F.lit("y").alias("street"))
    return joins.interpolate(ways, refs, nodes, numbers).select("way_id", "number", "lon", F.round("lat", 6).alias("lat"))


@query("J4_parent_chain", "WITH RECURSIVE w AS (SELECT id, parent_id AS at, [id] AS seen, 0 AS hop FROM v_parent UNION ALL SELECT w.id, p.parent_id, list_append(w.seen, w.at), hop + 1 FROM w JOIN v_parent p ON p.id = w.at WHERE NOT list_contains(w.seen, w.at) AND hop < 12) SELECT id, array_to_string(list_reverse(seen[2:]), ',') AS path FROM (SELECT id, seen, row_number() OVER (PARTITION BY id ORDER BY hop DESC) AS n FROM w) WHERE n = 1")
def j4(spark, d):
    return joins.parent_chains(view(spark, d, "v_parent")).select("id", F.array_join(F.transform("admin_path", lambda x: x.cast("string")), ",").alias("path"))


@query("J12_bundle_diff", "SELECT coalesce(o.p, n.p) AS path, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT s_suppkey AS p, s_acctbal AS h FROM supplier WHERE s_suppkey % 5 <> 0) o FULL JOIN (SELECT s_suppkey AS p, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_acctbal END AS h FROM supplier WHERE s_suppkey % 7 <> 0) n ON o.p = n.p WHERE o.p IS NULL OR n.p IS NULL OR o.h <> n.h")
def j12(spark, d):
    s = view(spark, d, "supplier")
    old = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("path"), F.col("s_acctbal").alias("hash"))
    new = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 3 == 0, 0.0).otherwise(F.col("s_acctbal")).alias("hash"))
    return joins.diff_files(old, new)


@query("J13_label_lookup", "SELECT place_id, 0 AS pos, r_name AS name FROM v_places JOIN region ON region_id = r_regionkey + 1 UNION ALL SELECT place_id, 1, n_name FROM v_places JOIN nation ON nation_id = n_nationkey + 1000")
def j13(spark, d):
    names_ = view(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("aid"), F.col("r_name").alias("name")).unionByName(view(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("aid"), F.col("n_name").alias("name")))
    return views.places(spark, d).select("place_id", F.posexplode("admin_path").alias("pos", "aid")).join(names_, "aid").select("place_id", "pos", "name")


@query("A3_pip_once", "SELECT qid, id, min(a) AS area FROM (SELECT l_orderkey AS qid, l_suppkey AS id, l_quantity AS a FROM lineitem) GROUP BY 1, 2")
def a3(spark, d):
    return view(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("id")).agg(F.min("l_quantity").alias("area"))


@query("A7_bundle_info", f"SELECT count(*) AS tiles, sum(n)::BIGINT AS places, max(n) AS largest FROM (SELECT level, {TILE_SQL} AS t, count(*) AS n FROM v_places GROUP BY 1, 2)")
def a7(spark, d):
    from ..functions.ids import tile_id

    t = view(spark, d, "v_places").groupBy("level", tile_id(F.col("level"), F.col("lon"), F.col("lat")).alias("t")).agg(F.count("*").alias("n"))
    return t.agg(F.count("*").alias("tiles"), F.sum("n").alias("places"), F.max("n").alias("largest"))


@query("A8_op_histogram", "SELECT kind, action, count(*) AS n, sum(CASE WHEN tag IN ('name', 'shop') THEN 1 ELSE 0 END)::BIGINT AS taggable FROM v_ops GROUP BY 1, 2")
def a8(spark, d):
    return view(spark, d, "v_ops").groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum(F.col("tag").isin(schema.TAGGABLE).cast("long")).alias("taggable"))


@query("A9_dirty_tiles", f"SELECT 0 AS level, t0 AS tile_id FROM (SELECT DISTINCT {TILE[0]} AS t0 FROM v_ops) UNION ALL SELECT 1, t1 FROM (SELECT DISTINCT {TILE[1]} AS t1 FROM v_ops) UNION ALL SELECT 2, t2 FROM (SELECT DISTINCT {TILE[2]} AS t2 FROM v_ops)")
def a9(spark, d):
    return joins.dirty_tiles(view(spark, d, "v_ops"))


@query("T4_latest_version", "SELECT kind, id, version FROM (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY version DESC, seq DESC) AS n FROM v_ops) WHERE n = 1 AND action <> 'delete'")
def t4(spark, d):
    return joins.latest_versions(view(spark, d, "v_ops")).select("kind", "id", "version")


@query("A13_distinct_refs", "SELECT DISTINCT l_partkey AS node_id FROM lineitem")
def a13(spark, d):
    return view(spark, d, "v_ways").select("node_id").distinct()


@query("A14_latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1")
def a14(spark, d):
    return view(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.99), 4).alias("p99"))


@query("A15_max_node_id", "SELECT max(id) AS max_id FROM v_nodes")
def a15(spark, d):
    return view(spark, d, "v_nodes").agg(F.max("id").alias("max_id"))


@query("F9_taggable_ops", "SELECT seq FROM v_ops WHERE tag IN ('name', 'shop')")
def f9(spark, d):
    tags = F.array(F.struct(F.col("tag").alias("key"), F.lit("v").alias("value")))
    return view(spark, d, "v_ops").where(F.exists(tags, lambda t: t["key"].isin(schema.TAGGABLE))).select("seq")


@query("F11_class_filter", "SELECT place_id FROM v_places WHERE kind = 'poi'")
def f11(spark, d):
    return view(spark, d, "v_places").where(schema.reverse_class(F.col("kind")) == "poi").select("place_id")


@query("W13_limits", "SELECT p_partkey, least(greatest(CASE WHEN p_size % 4 = 0 THEN 10 ELSE p_size * 3 END, 1), 100) AS lim FROM part")
def w13(spark, d):
    return view(spark, d, "part").select("p_partkey", F.least(F.greatest(F.coalesce(F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 3), F.lit(10)), F.lit(1)), F.lit(100)).alias("lim"))


@query("W8_federated_merge", f"SELECT qid, place_id, row_number() OVER (PARTITION BY qid ORDER BY area, place_id)::INT AS rank FROM ({BOX_AT})")
def w8(spark, d):
    a = views.admin(spark, d)
    parts = [spatial.point_in_polygon(view(spark, d, "v_points"), a.where(c)) for c in ("kind = 'country'", "kind <> 'country'")]
    return parts[0].unionByName(parts[1]).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("area", "place_id"))).select("qid", "place_id", "rank")


@query("U4_set_difference", "SELECT s_suppkey AS path FROM supplier WHERE s_suppkey % 7 = 0")
def u4(spark, d):
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("path"))
    return s.join(s.where("path % 7 <> 0"), "path", "left_anti")


@query("N34_polygon_area", "SELECT place_id, round((x1 - x0) * (y1 - y0) * CASE shape WHEN 'L' THEN 0.75 ELSE 1 END, 6) AS area FROM v_box")
def n34(spark, d):
    return views.admin(spark, d).select("place_id", F.round(F.abs(F.expr(geo.signed_area("polygon[0][0]"))), 6).alias("area"))
