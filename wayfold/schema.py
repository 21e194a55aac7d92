"""Schemas, kinds, levels and other fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = "array<struct<lang:string,value:string>>"
TAGS = "array<struct<key:string,value:string>>"
POLYGON = "array<array<array<struct<x:double,y:double>>>>"

PLACES = f"place_id long, level int, tile_id int, kind string, lon double, lat double, names {NAMES}, admin_path array<long>, tags {TAGS}, source string, gid string, input_ord long"
ADMIN = f"place_id long, level int, kind string, name string, lon double, lat double, admin_path array<long>, source string, polygon {POLYGON}"
BUILDINGS = "id string, lon double, lat double, min_x double, min_y double, max_x double, max_y double, outer_ring array<struct<x:double,y:double>>, height double"

# Fixed values of the data model.
KINDS = ["country", "region", "county", "city", "district", "neighborhood", "street", "address", "poi", "postcode"]
KIND_RANK = {"country": 0, "region": 1, "county": 2, "city": 3, "district": 4, "neighborhood": 5}
KIND_LEVEL = {"country": 0, "region": 0, "county": 1, "city": 1, "postcode": 1, "district": 2, "neighborhood": 2, "street": 2, "address": 2, "poi": 2}
KIND_SLUG = {"country": "country", "region": "region", "county": "county", "city": "locality", "district": "borough", "neighborhood": "neighbourhood", "street": "street", "address": "address", "postcode": "postalcode", "poi": "venue"}
SOURCE_RANK = {"wof": 0, "osm": 1, "oa": 2, "overture": 3, "geonames": 4, "generic": 5, "unknown": 6}
LAYER_ALIAS = {"postalcode": "postcode", "postal_code": "postcode", "zip": "postcode", "zipcode": "postcode", "venue": "poi", "venues": "poi", "locality": "city", "macroregion": "region", "localadmin": "city"}
KIND_WORDS = {"country": "country", "region": "region", "state": "region", "province": "region", "county": "county", "city": "city", "town": "city", "locality": "city", "village": "city", "neighborhood": "neighborhood", "neighbourhood": "neighborhood", "borough": "neighborhood", "street": "street", "highway": "street", "road": "street", "address": "address", "house": "address", "postcode": "postcode", "postalcode": "postcode", "zip": "postcode", "zipcode": "postcode"}
WOF_PLACETYPE = {"country": "country", "dependency": "country", "macroregion": "region", "region": "region", "macrocounty": "county", "county": "county", "localadmin": "county", "borough": "city", "locality": "city", "metro_area": "city", "neighbourhood": "neighborhood", "microhood": "neighborhood", "campus": "neighborhood", "postalcode": "postcode"}
GEONAMES_CITY = ["PPLC", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLA5", "PPLG", "PPL", "PPLS", "PPLF", "PPLR", "PPLL", "STLMT"]
OSM_PLACE = {"country": "country", "state": "region", "region": "region", "province": "region", "county": "county", "city": "city", "town": "city", "village": "city", "hamlet": "city", "isolated_dwelling": "city", "suburb": "neighborhood", "neighbourhood": "neighborhood", "quarter": "neighborhood", "borough": "neighborhood", "locality": "city"}
OSM_ADMIN_LEVEL = {1: "country", 2: "country", 3: "region", 4: "region", 5: "county", 6: "county", 7: "city", 8: "city", 9: "district", 10: "neighborhood", 11: "neighborhood", 12: "neighborhood"}
POI_KEYS = ["amenity", "shop", "tourism", "office", "leisure", "historic", "craft", "emergency", "healthcare"]
HIGHWAYS = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "service", "pedestrian", "road", "track"]
KEPT_TAGS = ["place", "highway", "amenity", "shop", "tourism", "office", "leisure", "historic", "craft", "emergency", "healthcare", "boundary", "admin_level", "ISO3166-1", "ISO3166-2", "wikidata", "population", "postal_code", "addr:postcode", "addr:city", "addr:country"]
#: Kept besides, since validity and two categories are read from them.
KEPT_TOO = ["start_date", "end_date", "aeroway", "railway"]
TAGGABLE = ["place", "name", "amenity", "shop", "tourism", "office", "leisure", "historic", "craft", "emergency", "healthcare", "boundary", "highway", "addr:housenumber"]
REVERSE_CLASS = {"street": "street", "highway": "street", "road": "street", "address": "address", "poi": "poi", "amenity": "poi", "shop": "poi", "tourism": "poi", "leisure": "poi", "office": "poi", "historic": "poi", "healthcare": "poi", "emergency": "poi", "craft": "poi"}
CELLS = {0: (4.0, 90, 45), 1: (1.0, 360, 180), 2: (0.25, 1440, 720)}
"""Degrees a tile, columns, rows by level."""


def mapped(col: Column, table: dict, other: Column | None = None) -> Column:
    """``table[col]``, or ``other`` (null)."""
    out = None
    for value in dict.fromkeys(table.values()):
        keys = [k for k, v in table.items() if v == value]
        out = F.when(col.isin(keys), F.lit(value)) if out is None else out.when(col.isin(keys), F.lit(value))
    return out.otherwise(other if other is not None else F.lit(None))


def level_for_kind(kind: Column) -> Column:
    return mapped(kind, KIND_LEVEL, F.lit(2)).cast("int")


def kind_slug(kind: Column) -> Column:
    return mapped(kind, KIND_SLUG)


def kind_rank(kind: Column) -> Column:
    return mapped(kind, KIND_RANK).cast("int")


def parse_kind(word: Column) -> Column:
    """Of a free word; anything unknown is a point of interest."""
    return mapped(F.lower(F.trim(word)), KIND_WORDS, F.lit("poi"))


def normalize_layer(word: Column) -> Column:
    return mapped(word, LAYER_ALIAS, word)


def reverse_class(kind: Column) -> Column:
    return mapped(kind, REVERSE_CLASS)


def tag(tags: Column, key: str) -> Column:
    """The first value of a key, or null."""
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]
