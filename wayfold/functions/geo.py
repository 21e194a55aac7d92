"""Distances, boxes, rings and point-in-polygon, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii by use.
R_DEDUP_M, R_SEARCH_KM, R_FEDERATION_KM = 6_371_000.0, 6371.0088, 6371.0
METERS_PER_DEGREE = 111_319.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = R_SEARCH_KM) -> Column:
    """Great-circle distance in the radius's unit."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0))))


def planar2(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Squared degrees, as nearest-neighbour search ranks."""
    return (lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2)


def valid_coord(lon: Column, lat: Column, drop_zero: bool = False) -> Column:
    ok = lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return ok & ~((lon == 0) & (lat == 0)) if drop_zero else ok


def boxes_touch(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Closed boxes (min_x, min_y, max_x, max_y)."""
    return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])


def box_holds(box: tuple[Column, Column, Column, Column], lon: Column, lat: Column) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def meters_to_degrees(m: Column) -> Column:
    return m / METERS_PER_DEGREE


def ring_box(ring: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of a ring of struct(x, y)."""
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def ring_crossings(ring: str, px: str, py: str) -> str:
    """SQL: edges of a closed ring that a ray to the right of the point crosses; half-open in y, so a vertex counts once."""
    edge = f"{ring}[i].y > {py} <> {ring}[i + 1].y > {py}"
    at = f"{ring}[i].x + ({py} - {ring}[i].y) / ({ring}[i + 1].y - {ring}[i].y) * ({ring}[i + 1].x - {ring}[i].x)"
    return f"size(filter(sequence(0, size({ring}) - 2), i -> CASE WHEN ({edge.replace(' <> ', ') <> (')}) THEN {at} > {px} ELSE false END))"


def in_ring(ring: str, px: str, py: str) -> str:
    """SQL: if the point is inside; rings of fewer than 4 vertices hold nothing."""
    return f"(CASE WHEN size({ring}) >= 4 THEN {ring_crossings(ring, px, py)} % 2 = 1 ELSE false END)"


def in_polygon(polygon: str, px: str, py: str) -> str:
    """SQL: inside some part's outer ring and none of its holes."""
    return f"exists({polygon}, part -> {in_ring('part[0]', px, py)} AND NOT exists(slice(part, 2, greatest(size(part) - 1, 0)), hole -> {in_ring('hole', px, py)}))"


def signed_area(ring: str) -> str:
    """SQL: shoelace; positive if counter-clockwise."""
    return f"(aggregate(sequence(0, greatest(size({ring}) - 2, 0)), 0D, (s, i) -> s + coalesce(get({ring}, i).x * get({ring}, i + 1).y - get({ring}, i + 1).x * get({ring}, i).y, 0D)) / 2)"


def ring_centroid(ring: str) -> str:
    """SQL: struct(lon, lat) by the shoelace formula; of a ring without area, the middle of its box."""
    x = f"aggregate(sequence(0, greatest(size({ring}) - 2, 0)), 0D, (s, i) -> s + coalesce((get({ring}, i).x + get({ring}, i + 1).x) * (get({ring}, i).x * get({ring}, i + 1).y - get({ring}, i + 1).x * get({ring}, i).y), 0D))"
    y = x.replace(f"(get({ring}, i).x + get({ring}, i + 1).x) *", f"(get({ring}, i).y + get({ring}, i + 1).y) *")
    mid = f"named_struct('lon', (array_min(transform({ring}, v -> v.x)) + array_max(transform({ring}, v -> v.x))) / 2, 'lat', (array_min(transform({ring}, v -> v.y)) + array_max(transform({ring}, v -> v.y))) / 2)"
    area = signed_area(ring)
    return f"(CASE WHEN abs({area}) < 1e-18 THEN {mid} ELSE named_struct('lon', {x} / (6 * {area}), 'lat', {y} / (6 * {area})) END)"
