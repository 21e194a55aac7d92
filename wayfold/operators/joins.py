"""Joins and aggregations of the build: ways and nodes, interpolation, parent chains, ring assembly, Wikidata, diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OSM_ADMIN_LEVEL, TAGS, mapped
from ..scratch import materialize


def node_coords(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id, pos, node_id, lon, lat`` of the references whose node exists; nodes nobody refers to never reach the join."""
    used = nodes.join(refs.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi")
    return refs.join(used.select(F.col("id").alias("node_id"), "lon", "lat"), "node_id")


def way_centroids(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id, lon, lat, n``: the mean of the coordinates found; ways without any are dropped."""
    return node_coords(refs, nodes).groupBy("way_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("n"))


def arc_lengths(points: DataFrame, key: str = "way_id") -> DataFrame:
    """Adds ``step`` to the next vertex and ``cum``, the planar length up to the vertex."""
    w = Window.partitionBy(key).orderBy("pos")
    dx, dy = F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w)
    return points.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).withColumn("cum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def interpolate(ways: DataFrame, refs: DataFrame, nodes: DataFrame, addresses: DataFrame) -> DataFrame:
    """``way_id, number, lon, lat, street``: house numbers between the two ends of an interpolation way, placed by arc length.

    ways: ``way_id, kind, street``; addresses: ``node_id, number, street``. Both ends need a
    whole number; odd and even step by 2, all and 1 by 1; a way with a missing node is left out.
    """
    sizes = refs.groupBy("way_id").agg(F.min_by("node_id", "pos").alias("start"), F.max_by("node_id", "pos").alias("end"), F.count("*").alias("n"))
    ends = ways.join(sizes, "way_id").where("n >= 2")
    a = addresses.select(F.col("node_id").alias("start"), F.col("number").try_cast("long").alias("n0"), F.col("street").alias("s0"))
    b = addresses.select(F.col("node_id").alias("end"), F.col("number").try_cast("long").alias("n1"), F.col("street").alias("s1"))
    step = F.when(F.col("kind").isin("odd", "even"), 2).when(F.col("kind").isin("all", "1"), 1)
    ends = ends.join(a, "start").join(b, "end").withColumn("step_by", step).where("n0 IS NOT NULL AND n1 IS NOT NULL AND n0 <> n1 AND step_by IS NOT NULL")
    ends = ends.select("way_id", "n", F.least("n0", "n1").alias("lo"), F.greatest("n0", "n1").alias("hi"), (F.col("n0") > F.col("n1")).alias("back"), "step_by", F.coalesce("street", "s0", "s1").alias("street"))
    found = node_coords(refs, nodes)
    whole = found.groupBy("way_id").agg(F.count("*").alias("got")).join(ends, "way_id").where("got = n")
    line = found.join(whole.select("way_id", "back"), "way_id").withColumn("pos", F.when(F.col("back"), -F.col("pos")).otherwise(F.col("pos"))).drop("back")
    line = arc_lengths(line)
    w = Window.partitionBy("way_id").orderBy("pos")
    segments = line.select("way_id", F.lag("lon").over(w).alias("x0"), F.lag("lat").over(w).alias("y0"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), (F.col("cum") - F.col("step")).alias("c0"), F.col("cum").alias("c1"), F.max("cum").over(Window.partitionBy("way_id")).alias("total"), F.row_number().over(w).alias("k")).where("k > 1")
    numbers = whole.where("hi - lo > step_by").select("way_id", "lo", "hi", "street", F.explode(F.expr("sequence(lo + step_by, hi - 1, step_by)")).alias("number"))
    placed = numbers.join(segments, "way_id").withColumn("at", (F.col("number") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("total"))
    placed = placed.where("at >= c0 AND at <= c1 AND c1 > c0").withColumn("first", F.row_number().over(Window.partitionBy("way_id", "number").orderBy("k"))).where("first = 1")
    t = (F.col("at") - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return placed.select("way_id", "number", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("lon"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("lat"), "street")


HOPS = 12


def parent_chains(nodes: DataFrame, hops: int = HOPS) -> DataFrame:
    """``id, admin_path``, root to leaf, by following parents (12 at most, never in a circle).

    nodes: ``id, parent_id``. Each hop is one equi-join of what is still walking, written out, and the last is the first that
    moves nothing; an id without a row is walked no further and left out of the path.
    """
    edges = nodes.select(F.col("id").alias("at"), F.col("parent_id").alias("next"))
    walk = nodes.select("id", F.col("parent_id").alias("at"), F.array("id").alias("seen"))
    path = nodes.select("id", F.lit(0).alias("hop"), F.col("parent_id").alias("ancestor")).limit(0)
    for hop in range(hops):
        walk = walk.where("at IS NOT NULL AND NOT array_contains(seen, at)").join(edges, "at")
        walk = materialize(walk.select("id", F.col("at").alias("ancestor"), F.col("next").alias("at"), F.array_append("seen", F.col("at")).alias("seen")), "walk")
        if walk.isEmpty():
            break
        path = path.unionByName(walk.select("id", F.lit(hop).alias("hop"), "ancestor"))
    chain = path.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("h"), "ancestor"))), lambda x: x["ancestor"]).alias("admin_path"))  # 12 at most
    return nodes.select("id").join(chain, "id", "left").select("id", F.coalesce("admin_path", F.array().cast("array<long>")).alias("admin_path"))


def wof_records(spr: DataFrame, names: DataFrame) -> DataFrame:
    """Live gazetteer rows with their preferred names, ``default`` first."""
    from ..functions.names import sorted_names
    from ..schema import WOF_PLACETYPE

    live = spr.where("is_current <> 0 AND is_deprecated = 0 AND is_ceased = 0 AND NOT (longitude = 0 AND latitude = 0)").withColumn("kind", mapped(F.col("placetype"), WOF_PLACETYPE)).where("kind IS NOT NULL")
    own = names.where("privateuse = 'preferred'").groupBy("id").agg(F.collect_list(F.struct(F.col("language").alias("lang"), F.col("name").alias("value"))).alias("own"))
    base = F.array(F.struct(F.lit("default").alias("lang"), F.col("name").alias("value")))
    return live.join(own, "id", "left").withColumn("names", sorted_names(F.concat(base, F.coalesce("own", F.array().cast("array<struct<lang:string,value:string>>"))))).drop("own")


# ---- rings


def _assembled(members: list[tuple[list[int], list[tuple[float, float]]]]) -> list[list[tuple[float, float]]]:
    """Closed rings by chaining ways at shared end nodes, tail first; chains that do not close are left out."""
    left = [list(zip(ids, xy, strict=True)) for ids, xy in members if len(ids) >= 2]
    rings = []
    while left:
        chain = left.pop(0)
        while chain[0][0] != chain[-1][0]:
            tail = chain[-1][0]
            for k, way in enumerate(left):
                if way[0][0] == tail or way[-1][0] == tail:
                    way = left.pop(k)
                    chain = chain + (way[1:] if way[0][0] == tail else way[-2::-1])
                    break
            else:
                break
        if chain[0][0] == chain[-1][0]:
            ring = [chain[0][1]]
            for _, p in chain[1:]:
                if p != ring[-1]:
                    ring.append(p)
            if len(ring) >= 4 and not _crosses(ring):
                rings.append(ring)
    return rings


def _crosses(ring: list[tuple[float, float]]) -> bool:
    """If two edges that do not touch cross: a sweep along x over the edges whose boxes meet."""
    n = len(ring) - 1

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    edges = sorted((*sorted((ring[i][0], ring[i + 1][0])), *sorted((ring[i][1], ring[i + 1][1])), i) for i in range(n))
    open_: list[tuple] = []
    for x0, x1, y0, y1, i in edges:
        open_ = [e for e in open_ if e[1] >= x0]
        for _, _, v0, v1, j in open_:
            if v0 <= y1 and v1 >= y0 and abs(i - j) not in (1, n - 1):
                a, b, c, d = ring[i], ring[i + 1], ring[j], ring[j + 1]
                if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                    return True
        open_.append((x0, x1, y0, y1, i))
    return False


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def point_in_ring(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
            inside = not inside
    return inside


def polygon_of(outer: list[list[tuple[float, float]]], inner: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Parts with their holes: outer rings counter-clockwise, holes clockwise, each in the smallest outer ring that holds its first vertex; others dropped."""
    outer = [r if ring_area(r) > 0 else r[::-1] for r in outer]
    parts = [[r] for r in outer]
    for hole in inner:
        homes = [k for k, r in enumerate(outer) if point_in_ring(r, *hole[0])]
        if homes:
            parts[min(homes, key=lambda k: ring_area(outer[k]))].append(hole if ring_area(hole) < 0 else hole[::-1])
    return parts


RELATIONS = "rel_id long, polygon array<array<array<struct<x:double,y:double>>>>, skipped_rings int"


def assemble_relations(members: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rel_id, polygon, skipped_rings`` from ``rel_id, way_id, role, member_pos``: outer (or no) role and inner role. A relation's ways are its own, so each group is small."""
    wanted = refs.join(members.select("way_id").distinct(), "way_id", "left_semi")
    line = node_coords(wanted, nodes).groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id", "lon", "lat"))).alias("line"))
    rows = members.join(line, "way_id")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member_pos")
        ways = {True: [], False: []}
        for role, vertices in zip(pdf["role"], pdf["line"], strict=True):
            ways[role == "inner"].append(([v["node_id"] for v in vertices], [(v["lon"], v["lat"]) for v in vertices]))
        outer, inner = _assembled(ways[False]), _assembled(ways[True])
        parts = polygon_of(outer, inner)
        skipped = len(ways[False]) + len(ways[True]) - len(outer) - len(inner)
        shape = [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts] or None
        return pd.DataFrame({"rel_id": [pdf["rel_id"].iloc[0]], "polygon": [shape], "skipped_rings": [max(0, skipped)]})

    return rows.groupBy("rel_id").applyInPandas(build, RELATIONS)


def admin_kind(level):
    """Of an ``admin_level`` column, 1 to 12."""
    return mapped(level.try_cast("int"), OSM_ADMIN_LEVEL)


# ---- Wikidata

# Place kinds by class (P31).
P31_KIND = {
    "country": ["Q6256", "Q3624078", "Q7275"],
    "region": ["Q35657", "Q34876", "Q34772", "Q12046105", "Q1907114"],
    "county": ["Q484170", "Q47168", "Q1549591"],
    "city": ["Q515", "Q486972", "Q3957", "Q532", "Q15284", "Q5119", "Q1093829", "Q22746"],
    "district": ["Q174841"],
    "neighborhood": ["Q123705", "Q12076836"],
    "street": ["Q34442", "Q83620", "Q25934"],
    "postcode": ["Q37447"],
}


def enrich_wikidata(places: DataFrame, entities: DataFrame) -> DataFrame:
    """``places`` with labels and aliases they lack, cross-reference tags, and points of interest promoted by their first known class.

    places needs ``wikidata`` (the Q-id, or null); entities: ``qid, labels, aliases`` (arrays of
    lang and value), ``geonames_id, iso_3166_2, fips_10_4, p131_parent, p31_types``.
    Running it again adds nothing.
    """
    rows = places.join(entities.withColumnRenamed("qid", "wikidata"), "wikidata", "left")
    empty = F.array().cast("array<struct<lang:string,value:string>>")
    more = F.concat(F.coalesce("labels", empty), F.transform(F.coalesce("aliases", empty), lambda a: F.struct(F.concat(a["lang"], F.lit("_alt")).alias("lang"), a["value"].alias("value"))))
    held = F.col("names")
    label = F.filter(more, lambda n: F.when(n["lang"].endswith("_alt"), ~F.exists(held, lambda h: (h["lang"] == n["lang"]) & (h["value"] == n["value"]))).otherwise(~F.exists(held, lambda h: h["lang"] == n["lang"])))
    refs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("geonames_id", "geonames_id"), ("iso_3166_2", "iso_3166_2"), ("fips_10_4", "fips_10_4"), ("wikidata_parent", "p131_parent"))]), lambda t: t["value"].isNotNull())
    new_tags = F.filter(refs, lambda t: ~F.exists(F.col("tags"), lambda h: h["key"] == t["key"]))
    kind_of = {q: k for k, qs in P31_KIND.items() for q in qs}
    first = F.get(F.filter(F.transform(F.coalesce("p31_types", F.array().cast("array<string>")), lambda q: mapped(q, kind_of)), lambda k: k.isNotNull()), F.lit(0))
    rows = rows.withColumns({"names": F.concat(held, label), "tags": F.concat(F.col("tags"), new_tags).cast(TAGS), "kind": F.when(F.col("kind") == "poi", F.coalesce(first, F.col("kind"))).otherwise(F.col("kind"))})
    return rows.select(*places.columns)


# ---- bundles


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: changed, added or removed, by hash. Both: ``path, hash``."""
    rows = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return rows.select("path", change.alias("change")).where("change IS NOT NULL")


def apply_diff(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """The files after the diff: what is added or changed comes from the new ones, what is removed goes."""
    kept = old.join(diff.select("path"), "path", "left_anti")
    return kept.unionByName(new.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi"))


def latest_versions(ops: DataFrame) -> DataFrame:
    """The last version of each (kind, id), deletions left out."""
    order = Window.partitionBy("kind", "id").orderBy(F.desc("version"), F.desc("seq"))
    return ops.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND action <> 'delete'").drop("_n")


def dirty_tiles(ops: DataFrame) -> DataFrame:
    """``level, tile_id``: tiles of all three levels that an operation with coordinates touches."""
    from ..functions.ids import tile_id

    each = ops.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
    return each.select("level", tile_id(F.col("level"), F.col("lon"), F.col("lat")).alias("tile_id")).distinct()


def extract(places: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """All places of the tiles that touch the box, whole tiles, each level by its own grid."""
    from ..functions import ids

    p = places.withColumn("tile_id", ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")))
    box = ids.tile_bbox(F.col("level"), F.col("tile_id"))
    return p.where((box["max_x"] >= min_x) & (box["min_x"] <= max_x) & (box["max_y"] >= min_y) & (box["min_y"] <= max_y))
