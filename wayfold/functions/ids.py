"""Packed place ids, the tile grid, Morton order and stable gids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CELLS

TILE_BITS, LOCAL_BITS = 22, 39


def pack_id(level: Column, tile: Column, local: Column) -> Column:
    """[level:3 | tile:22 | local:39]; null if a part is out of its range."""
    packed = F.shiftleft(level.cast("long"), TILE_BITS + LOCAL_BITS).bitwiseOR(F.shiftleft(tile.cast("long"), LOCAL_BITS)).bitwiseOR(local.cast("long"))
    return F.when(level.between(0, 2) & tile.between(0, (1 << TILE_BITS) - 1) & local.between(0, (1 << LOCAL_BITS) - 1), packed)


def id_level(place_id: Column) -> Column:
    return F.shiftrightunsigned(place_id, TILE_BITS + LOCAL_BITS).cast("int")


def id_tile(place_id: Column) -> Column:
    return F.shiftrightunsigned(place_id, LOCAL_BITS).bitwiseAND((1 << TILE_BITS) - 1).cast("int")


def id_local(place_id: Column) -> Column:
    return place_id.bitwiseAND((1 << LOCAL_BITS) - 1)


def _by_level(level: Column, k: int) -> Column:
    return F.when(level == 0, F.lit(CELLS[0][k])).when(level == 1, F.lit(CELLS[1][k])).otherwise(F.lit(CELLS[2][k]))


def tile_col(level: Column, lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / _by_level(level, 0)), F.lit(0).cast("long")), (_by_level(level, 1) - 1).cast("long")).cast("int")


def tile_row(level: Column, lat: Column) -> Column:
    return F.least(F.greatest(F.floor((lat + 90.0) / _by_level(level, 0)), F.lit(0).cast("long")), (_by_level(level, 2) - 1).cast("long")).cast("int")


def tile_id(level: Column, lon: Column, lat: Column) -> Column:
    """Row-major number in the level's grid; what lies outside goes to the edge."""
    return (tile_row(level, lat) * _by_level(level, 1) + tile_col(level, lon)).cast("int")


def tile_bbox(level: Column, tile: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of a tile."""
    cell, cols = _by_level(level, 0), _by_level(level, 1)
    x, y = (tile % cols) * cell - 180.0, F.floor(tile / cols) * cell - 90.0
    return F.struct(x.alias("min_x"), y.alias("min_y"), (x + cell).alias("max_x"), (y + cell).alias("max_y"))


def tiles_of_bbox(level: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """All tiles that a box touches, as an array to explode; a box that crosses nothing but its own tile gives one."""
    c0, c1, r0, r1 = tile_col(level, min_x), tile_col(level, max_x), tile_row(level, min_y), tile_row(level, max_y)
    return F.flatten(F.transform(F.sequence(r0, F.greatest(r0, r1)), lambda r: F.transform(F.sequence(c0, F.greatest(c0, c1)), lambda c: (r * _by_level(level, 1) + c).cast("int"))))


def _spread(v: Column) -> Column:
    v = v.cast("long").bitwiseAND(0xFFFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton2d(x: Column, y: Column) -> Column:
    """Bits of x in even places, bits of y in odd ones; neighbours in the plane stay near."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def quantize(degrees: Column) -> Column:
    """Thousandths of a degree, half away from zero."""
    return F.round(degrees * 1000.0).cast("int")


def synthesize_gid(source: Column, kind: Column, id_: Column) -> Column:
    return F.when(F.trim(id_) != "", F.concat_ws(":", source, kind, F.trim(id_)))


def stable_hash_gid(source: Column, kind: Column, name: Column, lon: Column, lat: Column) -> Column:
    """The same for equal kind, lower-cased name and grid cell, from any build."""
    key = F.concat_ws("|", F.lower(kind), F.lower(F.trim(name)), quantize(lon).cast("string"), quantize(lat).cast("string"))
    return F.concat(source, F.lit(":"), kind, F.lit(":h"), F.substring(F.sha2(key, 256), 1, 16))
