"""Spatial joins by tile keys: point in polygon, enrichment, nearest neighbours, buildings.

No join here has a range condition alone: polygons are filed under all tiles that their
box touches, at their own level, points under one tile a level, and an equi-join on
(level, tile) comes before the exact test. Geometry joins late: only keys and boxes are
replicated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, ids
from ..schema import CELLS, kind_rank
from ..scratch import materialize


def with_boxes(admin: DataFrame) -> DataFrame:
    """Adds the box of the whole polygon, ``area`` of the first part's box, and ``part_box``."""
    boxes = F.transform("polygon", lambda part: geo.ring_box(F.get(part, F.lit(0))))
    rows = admin.withColumn("_b", boxes)
    first = F.get("_b", F.lit(0))
    rows = rows.withColumns(
        {
            "min_x": F.array_min(F.transform("_b", lambda b: b["min_x"])),
            "min_y": F.array_min(F.transform("_b", lambda b: b["min_y"])),
            "max_x": F.array_max(F.transform("_b", lambda b: b["max_x"])),
            "max_y": F.array_max(F.transform("_b", lambda b: b["max_y"])),
            "area": (first["max_x"] - first["min_x"]) * (first["max_y"] - first["min_y"]),
        }
    )
    return rows.drop("_b")


def admin_tiles(admin: DataFrame) -> DataFrame:
    """``level, tile_id, place_id`` and box: a polygon's keys, without its geometry."""
    rows = admin if "min_x" in admin.columns else with_boxes(admin)
    tiles = ids.tiles_of_bbox(F.col("level"), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    return rows.select("level", "place_id", "min_x", "min_y", "max_x", "max_y", "area", F.explode(tiles).alias("tile_id"))


def point_keys(points: DataFrame, id_col: str) -> DataFrame:
    """A row for each point and level: ``level, tile_id, <id>, lon, lat``."""
    levels = F.explode(F.array(*[F.lit(k) for k in CELLS])).alias("level")
    rows = points.select(id_col, "lon", "lat", levels)
    return rows.withColumn("tile_id", ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")))


def point_in_polygon(points: DataFrame, admin: DataFrame, id_col: str = "qid") -> DataFrame:
    """``<id>, place_id, kind, name, area``: the polygons that hold each point, each once."""
    boxed = with_boxes(admin)
    near = point_keys(points, id_col).join(admin_tiles(boxed), ["level", "tile_id"]).where("lon BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y").select(id_col, "lon", "lat", "place_id", "area").distinct()
    held = near.join(boxed.select("place_id", "kind", "name", "polygon", F.col("lon").alias("centre_lon"), F.col("lat").alias("centre_lat")), "place_id").where(F.expr(geo.in_polygon("polygon", "lon", "lat")))
    return held.groupBy(id_col, "place_id").agg(F.min("area").alias("area"), F.first("kind").alias("kind"), F.first("name").alias("name"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.first("centre_lon").alias("centre_lon"), F.first("centre_lat").alias("centre_lat"))


def finest_first(hits: DataFrame, id_col: str = "qid", limit: int | None = None) -> DataFrame:
    """Adds ``rank``: smallest box first, then the id."""
    rows = hits.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("area", "place_id")))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def admin_path(hits: DataFrame, id_col: str) -> DataFrame:
    """``<id>, admin_path``: root to leaf by kind rank, then larger boxes first."""
    ranked = hits.where(kind_rank(F.col("kind")).isNotNull())
    chain = F.array_sort(F.collect_list(F.struct(kind_rank(F.col("kind")).alias("rank"), (-F.col("area")).alias("area"), "place_id")))  # a point's admin chain
    return ranked.groupBy(id_col).agg(F.transform(chain, lambda x: x["place_id"]).alias("admin_path"))


def enrich_places(places: DataFrame, admin: DataFrame) -> DataFrame:
    """Fills ``admin_path`` where it is empty: what holds the place, less itself and its own kind."""
    open_ = places.where(F.coalesce(F.size("admin_path"), F.lit(0)) <= 0).select(F.col("place_id").alias("pid"), F.col("kind").alias("own"), "lon", "lat")
    hits = point_in_polygon(open_, admin, "pid").join(open_.select("pid", "own"), "pid").where("place_id <> pid AND kind <> own")
    return places.join(admin_path(hits, "pid").withColumnRenamed("admin_path", "_path"), F.col("place_id") == F.col("pid"), "left").withColumn("admin_path", F.when(F.coalesce(F.size("admin_path"), F.lit(0)) > 0, F.col("admin_path")).otherwise(F.coalesce("_path", F.array().cast("array<long>")))).drop("_path", "pid")


def enrich_admin(admin: DataFrame) -> DataFrame:
    """As ``enrich_places`` for the features themselves: only strictly coarser kinds."""
    open_ = admin.where(F.coalesce(F.size("admin_path"), F.lit(0)) <= 0).select(F.col("place_id").alias("pid"), kind_rank(F.col("kind")).alias("own"), "lon", "lat")
    hits = point_in_polygon(open_, admin, "pid").join(open_.select("pid", "own"), "pid").where((F.col("place_id") != F.col("pid")) & (kind_rank(F.col("kind")) < F.col("own")))
    return admin.join(admin_path(hits, "pid").withColumnRenamed("admin_path", "_path"), F.col("place_id") == F.col("pid"), "left").withColumn("admin_path", F.when(F.coalesce(F.size("admin_path"), F.lit(0)) > 0, F.col("admin_path")).otherwise(F.coalesce("_path", F.array().cast("array<long>")))).drop("_path", "pid")


# ---- nearest neighbours

def _round(queries: DataFrame, points: DataFrame, k: int, cell: float, reach: int) -> DataFrame:
    """Candidates within ``reach`` cells; a query is settled if its k-th is nearer than the ring's edge."""
    x, y = lambda c: F.floor((F.col(c) + 180.0) / cell), lambda c: F.floor((F.col(c) + 90.0) / cell)
    span = F.sequence(F.lit(-reach), F.lit(reach))
    asked = queries.withColumn("cx", F.explode(F.transform(span, lambda d: x("lon") + d))).withColumn("cy", F.explode(F.transform(span, lambda d: y("lat") + d)))
    filed = points.select(F.col("place_id"), F.col("lon").alias("plon"), F.col("lat").alias("plat"), x("lon").alias("cx"), y("lat").alias("cy"))
    d2 = geo.planar2(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    near = asked.join(filed, ["cx", "cy"]).withColumn("d2", d2)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "place_id"))).where(F.col("rank") <= k)
    edge = F.least(F.col("lon") + 180.0 - x("lon") * cell, (x("lon") + 1) * cell - F.col("lon") - 180.0, F.col("lat") + 90.0 - y("lat") * cell, (y("lat") + 1) * cell - F.col("lat") - 90.0) + reach * cell
    return ranked.withColumn("edge2", edge * edge)


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float = 0.25) -> DataFrame:
    """``qid, place_id, rank, d2``: the k points with the least squared degrees, exactly, ties to the smaller id.

    Cells around each query are joined by key, in rings that grow until every query's k-th
    neighbour is nearer than the ring's edge; the last ring spans the globe, so each
    query settles, and each round takes only the queries the one before left (rounds
    are written out, so none is computed twice).
    """
    left, out, width = materialize(queries.select("qid", "lon", "lat"), "asked"), None, cell
    points = points.select("place_id", "lon", "lat")
    while True:
        last = width * 8 >= 360.0
        ranked = materialize(_round(left, points, k, width, 2 if not last else int(360.0 // width) + 2), "near")
        full = ranked.groupBy("qid").agg(F.count("*").alias("n"), F.max("d2").alias("far"), F.first("edge2").alias("edge2"))
        done = full if last else full.where((F.col("n") >= k) & (F.col("far") <= F.col("edge2")))
        got = ranked.join(done.select("qid"), "qid", "left_semi").select("qid", "place_id", "rank", "d2")
        out = got if out is None else out.unionByName(got)
        if last:
            return out
        left = materialize(left.join(done.select("qid"), "qid", "left_anti"), "asked")
        if left.isEmpty():
            return out
        width *= 8


def reverse(queries: DataFrame, admin: DataFrame, places: DataFrame, limit: int = 10, near: int = 1) -> DataFrame:
    """``qid, source, rank, place_id, distance_km``: polygons that hold the point, finest first; where none does, its nearest places."""
    hits = materialize(finest_first(point_in_polygon(queries, admin), limit=limit), "hits")
    pip = hits.select("qid", F.lit("pip").alias("source"), "rank", "place_id", geo.haversine(F.col("lon"), F.col("lat"), F.col("centre_lon"), F.col("centre_lat")).alias("distance_km"))
    rest = queries.join(hits.select("qid").distinct(), "qid", "left_anti")
    knn = nearest(rest, places, min(near, limit)).join(rest.select("qid", "lon", "lat"), "qid").join(places.select("place_id", F.col("lon").alias("plon"), F.col("lat").alias("plat")), "place_id")
    return pip.unionByName(knn.select("qid", F.lit("nearest").alias("source"), "rank", "place_id", geo.haversine(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat")).alias("distance_km")))


def reverse_full(queries: DataFrame, admin: DataFrame, places: DataFrame, classes: Column) -> DataFrame:
    """``qid, class, rank, place_id``: the admin chain, and the nearest street, poi and address."""
    chain = finest_first(point_in_polygon(queries, admin)).select("qid", F.lit("admin").alias("class"), "rank", "place_id")
    classed = places.withColumn("class", classes)
    found = [nearest(queries, classed.where(F.col("class") == c), 1).select("qid", F.lit(c).alias("class"), "rank", "place_id") for c in ("street", "poi", "address")]
    return reduce(DataFrame.unionByName, found, chain)


# ---- buildings


def buildings_at(points: DataFrame, buildings: DataFrame, strict: bool = True, limit: int | None = None, id_col: str = "qid") -> DataFrame:
    """``<id>, id, rank, area, height``: buildings whose ring (or, unless strict, box) holds the point, smallest box first; a vertex is inside."""
    level, box = F.lit(2), ["min_x", "min_y", "max_x", "max_y"]
    whole = buildings.where("NOT isnan(min_x) AND NOT isnan(max_x)").select("id", *box, "height", *["outer_ring"] * strict)
    # Spark takes the rows before explode for the size of this table and would broadcast it: hence the hints.
    tiles = whole.select("id", *box).distinct().withColumn("tile_id", F.explode(ids.tiles_of_bbox(level, *[F.col(c) for c in box])))
    asked = points.select(id_col, "lon", "lat", ids.tile_id(level, F.col("lon"), F.col("lat")).alias("tile_id"))
    hits = asked.join(tiles.hint("merge"), "tile_id").where("lon BETWEEN min_x AND max_x AND lat BETWEEN min_y AND max_y").drop("tile_id")
    hits = hits.withColumnRenamed("id", "_id").join(whole.hint("merge"), box).where(F.col("_id").eqNullSafe(F.col("id")))
    if strict:
        hits = hits.where(F.expr(f"exists(outer_ring, v -> v.x = lon AND v.y = lat) OR {geo.in_ring('outer_ring', 'lon', 'lat')}"))
    hits = hits.withColumn("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("area", "id")))
    return (hits if limit is None else hits.where(F.col("rank") <= limit)).select(id_col, "id", "rank", "area", "height")


def attach_buildings(places: DataFrame, buildings: DataFrame) -> DataFrame:
    """``places`` with the tags ``building_id`` and ``building_height`` of the smallest building that holds them; running it again changes nothing."""
    hit = buildings_at(places.select(F.col("place_id").alias("qid"), "lon", "lat"), buildings, limit=1).select(F.col("qid").alias("place_id"), F.col("id").alias("_id"), F.col("height").alias("_h"))
    rows = places.join(hit, "place_id", "left")
    bare = F.filter("tags", lambda t: ~t["key"].isin("building_id", "building_height"))
    entry = lambda k, v: F.array(F.struct(F.lit(k).alias("key"), v.alias("value")))
    height = F.when(F.col("_h").isNotNull(), entry("building_height", F.format_string("%.1f", F.col("_h") + 1e-9))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return rows.withColumn("tags", F.when(F.col("_id").isNotNull(), F.concat(bare, entry("building_id", F.col("_id")), height)).otherwise(F.col("tags"))).drop("_id", "_h")
