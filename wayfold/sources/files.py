"""Readers of place sources: each gives rows of the places schema (without ids), with skipped rows counted where a reader can.

All read through Spark's own sources (CSV, text, JSON, Parquet); only geometry in WKB goes
through an Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import geo, ids, udfs
from ..schema import NAMES, TAGS


def _tags(pairs: list[tuple[str, Column]]) -> Column:
    """Entries whose value is not blank, in order."""
    made = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs]) if pairs else F.array()
    return F.filter(made.cast(TAGS), lambda t: F.coalesce(F.trim(t["value"]), F.lit("")) != "")


def _names(*pairs: tuple[str, Column]) -> Column:
    made = F.array(*[F.struct(F.lit(k).alias("lang") if isinstance(k, str) else k.alias("lang"), v.alias("value")) for k, v in pairs]).cast(NAMES)
    return F.filter(made, lambda n: F.coalesce(F.trim(n["value"]), F.lit("")) != "")


def _place(rows: DataFrame, source: str, kind: Column, lon: Column, lat: Column, names: Column, tags: Column, gid: Column) -> DataFrame:
    out = rows.select(kind.alias("kind"), lon.alias("lon"), lat.alias("lat"), names.alias("names"), F.array().cast("array<long>").alias("admin_path"), tags.alias("tags"), F.lit(source).alias("source"), gid.alias("gid"))
    out = out.withColumn("gid", F.coalesce("gid", ids.stable_hash_gid(F.lit(source), schema.kind_slug(F.col("kind")), F.col("names")[0]["value"], F.col("lon"), F.col("lat"))))
    return out.withColumn("level", schema.level_for_kind(F.col("kind")))


def _checked(rows: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """Adds ``_skip``: the first check that a row does not pass, or null."""
    skip = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks])
    return rows.withColumn("_skip", skip)


def import_counters(spark: SparkSession, source: str, path: str) -> DataFrame:
    """``counter, n`` of a file: rows seen, emitted, and skipped by the first check they fail. source: ``openaddresses``, ``geonames``, ``geonames_postcodes`` or ``generic_csv``."""
    rows = {"openaddresses": _openaddresses, "geonames": _geonames, "geonames_postcodes": _postcodes, "generic_csv": _generic}[source](spark, path)
    counted = rows.select(F.explode(F.array(F.lit("seen"), F.coalesce(F.concat(F.lit("skipped_"), F.col("_skip")), F.lit("emitted")))).alias("counter"))
    return counted.groupBy("counter").agg(F.count("*").alias("n"))


def openaddresses(spark: SparkSession, path: str) -> DataFrame:
    """OpenAddresses CSV: needs coordinates (not 0,0), number and street."""
    rows = _openaddresses(spark, path).where("_skip IS NULL")
    have = {c.upper(): c for c in rows.columns}
    col = lambda c: F.trim(F.coalesce(F.col(f"`{have[c]}`"), F.lit(""))) if c in have else F.lit("")
    name = F.concat(F.col("_n"), F.lit(" "), F.col("_s"), F.when(F.col("_u") != "", F.concat(F.lit(", "), F.col("_u"))).otherwise(""))
    tags = _tags([("addr:housenumber", F.col("_n")), ("addr:street", F.col("_s")), ("addr:unit", F.col("_u")), ("addr:city", col("CITY")), ("addr:district", col("DISTRICT")), ("addr:region", col("REGION")), ("addr:postcode", col("POSTCODE"))])
    return _place(rows, "oa", F.lit("address"), F.col("_lon"), F.col("_lat"), _names(("default", name)), tags, ids.synthesize_gid(F.lit("oa"), F.lit("address"), F.coalesce(F.when(col("HASH") != "", col("HASH")), col("ID"))))


def _openaddresses(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    have = {c.upper(): c for c in rows.columns}
    col = lambda c: F.trim(F.coalesce(F.col(f"`{have[c]}`"), F.lit(""))) if c in have else F.lit("")
    rows = rows.withColumns({"_lon": col("LON").try_cast("double"), "_lat": col("LAT").try_cast("double"), "_n": col("NUMBER"), "_s": col("STREET"), "_u": col("UNIT")})
    return _checked(rows, ("coordinates", geo.valid_coord(F.col("_lon"), F.col("_lat"), drop_zero=True)), ("number", F.col("_n") != ""), ("street", F.col("_s") != ""))


def _tsv(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Tab-separated text without quotes or header; missing columns are null."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(f"c{i}") for i in range(n)])


def geonames(spark: SparkSession, path: str) -> DataFrame:
    """Geonames TSV: populated places of known codes."""
    rows = _geonames(spark, path).where("_skip IS NULL")
    names = _names(("default", F.col("c1")), ("ascii", F.when(F.col("c2") != F.col("c1"), F.col("c2"))))
    tags = _tags([("country", F.col("c8")), ("feature_code", F.col("c7")), ("population", F.when(F.col("c14").try_cast("long") > 0, F.col("c14")))])
    return _place(rows, "geonames", F.col("_k"), F.col("_lon"), F.col("_lat"), names, tags, ids.synthesize_gid(F.lit("geonames"), schema.kind_slug(F.col("_k")), F.col("c0")))


def _geonames(spark: SparkSession, path: str) -> DataFrame:
    kind = F.when(F.col("c7").isin(schema.GEONAMES_CITY), "city").when(F.col("c7") == "PPLX", "neighborhood")
    rows = _tsv(spark, path, 19).withColumns({"_k": kind, "_lon": F.col("c5").try_cast("double"), "_lat": F.col("c4").try_cast("double")})
    return _checked(rows, ("class", F.col("c6") == "P"), ("code", F.col("_k").isNotNull()), ("name", F.trim("c1") != ""), ("coordinates", geo.valid_coord(F.col("_lon"), F.col("_lat"))))


def geonames_postcodes(spark: SparkSession, path: str) -> DataFrame:
    """Geonames postcode TSV: the code, and the code with its place, as names."""
    rows = _postcodes(spark, path).where("_skip IS NULL")
    names = _names(("default", F.col("c1")), ("default", F.when(F.trim("c2") != "", F.concat("c1", F.lit(" "), "c2"))))
    gid = F.when(F.trim("c0") != "", F.concat(F.lit("geonames:postalcode:"), "c0", F.lit("-"), "c1"))
    return _place(rows, "geonames", F.lit("postcode"), F.col("_lon"), F.col("_lat"), names, _tags([("addr:country", F.col("c0")), ("addr:postcode", F.col("c1")), ("addr:city", F.col("c2"))]), gid)


def _postcodes(spark: SparkSession, path: str) -> DataFrame:
    rows = _tsv(spark, path, 12).withColumns({"_lon": F.col("c10").try_cast("double"), "_lat": F.col("c9").try_cast("double")})
    return _checked(rows, ("code", F.trim("c1") != ""), ("coordinates", geo.valid_coord(F.col("_lon"), F.col("_lat"))))


# Header words of generic tables.
LON, LAT, POPULATION, LANG = ["lon", "longitude", "lng", "x"], ["lat", "latitude", "y"], ["population", "pop"], ["lang", "language"]


def generic_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with any of the known headers; other columns become tags; without coordinates' headers, no rows."""
    rows = _generic(spark, path).where("_skip IS NULL")
    low = {c.strip().lower(): c for c in reversed(rows.columns) if not c.startswith("_")}
    used = {low[w] for words in (LON, LAT, ["name"], ["kind"], POPULATION, LANG) if (w := next((x for x in words if x in low), None))}
    tags = [(c.strip(), F.col(f"`{c}`")) for c in rows.columns if c not in used and not c.startswith("_")]
    if pop := next((low[w] for w in POPULATION if w in low), None):
        tags.append(("population", F.trim(F.col(f"`{pop}`"))))
    gid = ids.synthesize_gid(F.lit("generic"), schema.kind_slug(F.col("_k")), F.coalesce(F.trim(F.col(f"`{low['id']}`")) if "id" in low else F.lit(None).cast("string"), F.lit("")))
    return _place(rows, "generic", F.col("_k"), F.col("_x"), F.col("_y"), _names((F.col("_l"), F.col("_n"))), _tags(tags), gid)


def _generic(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    low = {c.strip().lower(): c for c in reversed(rows.columns)}

    def col(words: list[str]) -> Column | None:
        found = next((low[w] for w in words if w in low), None)
        return None if found is None else F.trim(F.col(f"`{found}`"))

    lon, lat, name, kind, lang = (col(w) for w in (LON, LAT, ["name"], ["kind"], LANG))
    if lon is None or lat is None or name is None:
        rows = rows.limit(0)
    none = F.lit(None).cast("string")
    lon, lat, name, lang = (none if c is None else c for c in (lon, lat, name, lang))
    rows = rows.withColumns({"_x": lon.try_cast("double"), "_y": lat.try_cast("double"), "_n": name, "_k": F.lit("poi") if kind is None else schema.parse_kind(F.coalesce(kind, F.lit("poi"))), "_l": F.coalesce(F.when(lang != "", lang), F.lit("default"))})
    return _checked(rows, ("coordinates", geo.valid_coord(F.col("_x"), F.col("_y"))), ("name", F.col("_n") != ""))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON collections, features or bare geometries: a point's place, or the first vertex of (multi)polygons and multipoints."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("j"))
    feature = "STRUCT<type: STRING, id: STRING, geometry: STRING, properties: STRING>"
    listed = raw.select(F.from_json("j", "STRUCT<features: ARRAY<STRING>, type: STRING>").alias("c"), "j")
    each = listed.select(F.explode(F.when(F.col("c.type") == "FeatureCollection", F.col("c.features")).otherwise(F.array("j"))).alias("f")).select(F.from_json("f", feature).alias("f"), F.col("f").alias("raw"))
    each = each.select(F.when(F.col("f.type") == "Feature", F.col("f.geometry")).otherwise(F.col("raw")).alias("g"), F.coalesce("f.properties", F.lit("{}")).alias("p"), F.col("f.id").alias("id"))
    kind = F.get_json_object("g", "$.type")
    depth = F.when(kind == "Point", "$.coordinates").when(kind == "MultiPoint", "$.coordinates[0]").when(kind == "Polygon", "$.coordinates[0][0]").when(kind == "MultiPolygon", "$.coordinates[0][0][0]")
    at = F.coalesce(*[F.when(depth == d, F.get_json_object("g", d)) for d in ("$.coordinates", "$.coordinates[0]", "$.coordinates[0][0]", "$.coordinates[0][0][0]")])
    each = each.withColumn("at", F.from_json(at, "ARRAY<DOUBLE>")).withColumn("props", F.from_json("p", "MAP<STRING,STRING>"))
    prop = lambda k: F.try_element_at("props", F.lit(k))
    each = each.withColumns({"_x": F.get("at", F.lit(0)), "_y": F.get("at", F.lit(1)), "_k": schema.parse_kind(F.coalesce(prop("kind"), prop("class"), F.lit("poi")))})
    each = each.where(geo.valid_coord(F.col("_x"), F.col("_y")) & (F.coalesce(F.trim(prop("name")), F.lit("")) != ""))
    entries = F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    langs = F.transform(F.filter(entries, lambda t: t["key"].rlike("^name:[^:]+$")), lambda t: F.struct(F.substring(t["key"], F.lit(6), F.length(t["key"])).alias("lang"), t["value"].alias("value")))
    names = F.concat(F.array(F.struct(F.lit("default").alias("lang"), prop("name").alias("value"))), langs).cast(NAMES)
    tags = F.filter(entries, lambda t: ~t["key"].isin("name", "kind", "class") & ~t["key"].startswith("name:") & t["value"].isNotNull() & ~t["value"].rlike(r"^[\[{]")).cast(TAGS)
    return _place(each, "generic", F.col("_k"), F.col("_x"), F.col("_y"), names, tags, ids.synthesize_gid(F.lit("generic"), schema.kind_slug(F.col("_k")), F.coalesce("id", F.lit(""))))


def geoparquet(spark: SparkSession, path: str, columns: dict[str, str] | None = None, kind: str = "poi", source: str = "generic", keep: list[str] | None = None) -> DataFrame:
    """Parquet points: coordinate columns if there are any, else a WKB point; null columns and (0,0) are dropped.

    columns: our names (``id, name, kind, lon, lat, geometry``) to the table's; a dotted name reaches into a struct.
    """
    columns = {"name": "name"} | (columns or {})
    rows = spark.read.parquet(path)
    has = lambda c: columns.get(c, c).split(".")[0] in rows.columns
    col = lambda c: F.col(columns.get(c, c)) if has(c) else F.lit(None)
    if has("lon") and has("lat"):
        rows = rows.withColumns({"_x": col("lon").cast("double"), "_y": col("lat").cast("double")})
    else:
        rows = rows.withColumn("_p", udfs.wkb_point(col("geometry"))).withColumns({"_x": F.col("_p.lon"), "_y": F.col("_p.lat")})
    rows = rows.withColumns({"_n": col("name").cast("string"), "_k": schema.parse_kind(col("kind").cast("string")) if has("kind") else F.lit(kind)})
    rows = rows.where(geo.valid_coord(F.col("_x"), F.col("_y"), drop_zero=True) & (F.coalesce(F.trim("_n"), F.lit("")) != ""))
    plain = {"string", "double", "float", "bigint", "int", "boolean"}
    tags = _tags([(c, F.col(f"`{c}`")) for c, t in rows.dtypes if t in plain and c in (keep or [])])
    return _place(rows, source, F.col("_k"), F.col("_x"), F.col("_y"), _names(("default", F.col("_n"))), tags, ids.synthesize_gid(F.lit(source), schema.kind_slug(F.col("_k")), F.coalesce(col("id").cast("string"), F.lit(""))))


def overture(spark: SparkSession, path: str, theme: str) -> DataFrame:
    """Overture themes ``places`` and ``addresses``, in their nested schema or a flat one."""
    rows = spark.read.parquet(path)
    if theme == "places":
        name = "names.primary" if "names" in rows.columns else "name"
        out = geoparquet(spark, path, {"name": name, "id": "id"}, "poi", "overture", ["confidence", "phone", "website", "category"])
        slug = "place"
    elif theme == "addresses":
        name = F.concat_ws(" ", "number", "street")
        tmp = rows.withColumn("_name", F.when(F.coalesce(F.trim("number"), F.lit("")) != "", name))
        x, y = (F.col("lon"), F.col("lat")) if "lon" in rows.columns else (udfs.wkb_point(F.col("geometry"))["lon"], udfs.wkb_point(F.col("geometry"))["lat"])
        tmp = tmp.withColumns({"_x": x, "_y": y}).where(geo.valid_coord(F.col("_x"), F.col("_y"), drop_zero=True) & F.col("_name").isNotNull())
        tags = _tags([("addr:housenumber", F.col("number")), ("addr:street", F.col("street"))] + [(f"addr:{c}", F.col(c)) for c in ("postcode", "country") if c in rows.columns])
        out = _place(tmp, "overture", F.lit("address"), F.col("_x"), F.col("_y"), _names(("default", F.col("_name"))), tags, F.concat(F.lit("overture:address:"), F.col("id").cast("string")))
        slug = "address"
    else:
        raise ValueError(theme)
    return out.withColumn("gid", F.regexp_replace("gid", "^overture:(venue|address):(?!h[0-9a-f]{16}$)", f"overture:{slug}:"))


def buildings(spark: SparkSession, path: str, geometry: str = "geometry", id_col: str = "id", height: str = "height") -> DataFrame:
    """Footprints from WKB polygons: the outer ring with the largest box; holes are dropped; an id is made where there is none."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn("_parts", udfs.wkb_polygons(F.col(geometry))).where(F.size("_parts") > 0)
    boxed = F.transform("_parts", lambda part: F.struct(((geo.ring_box(part[0])["max_x"] - geo.ring_box(part[0])["min_x"]) * (geo.ring_box(part[0])["max_y"] - geo.ring_box(part[0])["min_y"])).alias("area"), part[0].alias("ring")))
    rows = rows.withColumn("outer_ring", F.array_max(boxed)["ring"]).where(F.size("outer_ring") >= 4).withColumn("_b", geo.ring_box(F.col("outer_ring"))).withColumn("_c", F.expr(geo.ring_centroid("outer_ring")))
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("h"), F.substring(F.sha2(F.col(geometry), 256), 1, 16))) if id_col in rows.columns else F.concat(F.lit("h"), F.substring(F.sha2(F.col(geometry), 256), 1, 16))
    tall = F.col(height).cast("double") if height in rows.columns else F.lit(None).cast("double")
    return rows.select(name.alias("id"), F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat"), "_b.min_x", "_b.min_y", "_b.max_x", "_b.max_y", "outer_ring", F.when(~F.isnan(tall), tall).alias("height"))


def osm_node_places(nodes: DataFrame) -> DataFrame:
    """Places from nodes (``id, lon, lat, tags``): a known ``place`` value or a point-of-interest key, and a name."""
    from ..functions.names import collect_names, kept_tags

    place = schema.tag(F.col("tags"), "place")
    poi = F.exists("tags", lambda t: t["key"].isin(schema.POI_KEYS))
    kind = F.when(place.isNotNull(), schema.mapped(place, schema.OSM_PLACE)).when(poi, "poi")
    rows = nodes.withColumns({"_k": kind, "_n": collect_names(F.col("tags"))}).where(F.col("_k").isNotNull() & (F.size("_n") > 0))
    more = F.array(F.struct(F.lit("osm_type").alias("key"), F.lit("node").alias("value")), F.struct(F.lit("osm_id").alias("key"), F.col("id").cast("string").alias("value")))
    return _place(rows, "osm", F.col("_k"), F.col("lon"), F.col("lat"), F.col("_n"), F.concat(kept_tags(F.col("tags")), more).cast(TAGS), F.concat(F.lit("osm:node:"), F.col("id").cast("string")))


def osm_way_places(ways: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Streets from named highways (``way_id, tags``) of the kept classes, at the mean of their nodes."""
    from ..functions.names import collect_names, kept_tags
    from ..operators.joins import way_centroids

    rows = ways.withColumn("_n", collect_names(F.col("tags"))).where(schema.tag(F.col("tags"), "highway").isin(schema.HIGHWAYS) & (F.size("_n") > 0))
    rows = rows.join(way_centroids(refs.join(rows.select("way_id"), "way_id", "left_semi"), nodes), "way_id")
    more = F.array(F.struct(F.lit("osm_type").alias("key"), F.lit("way").alias("value")), F.struct(F.lit("osm_id").alias("key"), F.col("way_id").cast("string").alias("value")))
    return _place(rows, "osm", F.lit("street"), F.col("lon"), F.col("lat"), F.col("_n"), F.concat(kept_tags(F.col("tags")), more).cast(TAGS), F.concat(F.lit("osm:way:"), F.col("way_id").cast("string")))


WIKIDATA = "qid string, labels array<struct<lang:string,value:string>>, aliases array<struct<lang:string,value:string>>, geonames_id string, iso_3166_2 string, fips_10_4 string, p131_parent string, p31_types array<string>"


def wikidata(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Entities of a JSON-lines dump (gzip too) whose id is wanted (``qid``): the id is cut out and joined before anything is parsed; bad lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("j")).where("j NOT IN ('[', ']', '')")
    lines = lines.withColumn("qid", F.regexp_extract("j", r'"id"\s*:\s*"(Q[0-9]+)"', 1)).where("qid <> ''").join(wanted.select("qid").distinct(), "qid", "left_semi")
    claim = "ARRAY<STRUCT<mainsnak: STRUCT<datavalue: STRUCT<type: STRING, value: STRING>>, rank: STRING>>"
    form = f"STRUCT<labels: MAP<STRING, STRUCT<language: STRING, value: STRING>>, aliases: MAP<STRING, ARRAY<STRUCT<language: STRING, value: STRING>>>, claims: STRUCT<P1566: {claim}, P300: {claim}, P901: {claim}, P131: {claim}, P31: {claim}>>"
    rows = lines.withColumn("e", F.from_json("j", form)).where("e IS NOT NULL AND e.labels IS NOT NULL")
    live = lambda p: F.filter(F.col(f"e.claims.{p}"), lambda c: F.coalesce(c["rank"], F.lit("normal")) != "deprecated")
    plain = lambda p: F.get(F.transform(live(p), lambda c: c["mainsnak"]["datavalue"]["value"]), F.lit(0))
    entity = lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id")
    names = lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("lang"), F.try_element_at(m, k)["value"].alias("value")))
    aliases = F.flatten(F.transform(F.array_sort(F.map_keys("e.aliases")), lambda k: F.transform(F.try_element_at("e.aliases", k), lambda a: F.struct(k.alias("lang"), a["value"].alias("value")))))
    return rows.select("qid", names(F.col("e.labels")).alias("labels"), F.coalesce(aliases, F.array().cast(NAMES)).alias("aliases"), plain("P1566").alias("geonames_id"), plain("P300").alias("iso_3166_2"), plain("P901").alias("fips_10_4"), F.get(F.transform(live("P131"), entity), F.lit(0)).alias("p131_parent"), F.coalesce(F.transform(live("P31"), entity), F.array().cast("array<string>")).alias("p31_types"))


def write_places(places: DataFrame, path: str) -> None:
    """One folder a level, files sorted by Morton order of the tile, so that row groups are compact in the plane."""
    rows = places.withColumn("tile_id", ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")))
    cell = lambda f, c: f(F.col("level"), F.col(c))
    rows = rows.withColumn("_m", ids.morton2d(cell(ids.tile_col, "lon"), cell(ids.tile_row, "lat")))
    rows.repartitionByRange("level", "_m").sortWithinPartitions("level", "_m", "kind").drop("_m").write.mode("overwrite").option("compression", "zstd").partitionBy("level").parquet(path)


def write_tiled(rows: DataFrame, path: str, level: int | None = None) -> None:
    """Points or buildings (``lon, lat``) by tile: at ``level``, or at each row's own. Files are ranges of tiles, sorted, so that a tile is in one or two of them and its row groups are found by their statistics."""
    rows = rows.withColumn("level", F.lit(level)) if level is not None else rows
    rows = rows.withColumn("tile_id", ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")))
    rows.repartitionByRange("level", "tile_id").sortWithinPartitions("level", "tile_id").write.mode("overwrite").option("compression", "zstd").partitionBy("level").parquet(path)


def read_tiles(spark: SparkSession, path: str, level: int, tiles: list[int]) -> DataFrame:
    """The rows of some tiles: the level is a folder, the tiles are pushed down to the scan."""
    return spark.read.parquet(path).where((F.col("level") == level) & F.col("tile_id").isin(tiles))


def inspect(rows: DataFrame) -> DataFrame:
    """``level, tile_id, kind, n, min_id, max_id`` of tiled rows."""
    return rows.groupBy("level", "tile_id", "kind").agg(F.count("*").alias("n"), F.min("place_id").alias("min_id"), F.max("place_id").alias("max_id"))


def write_ndjson(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, hash`` of every file of a bundle: relative path and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def verify(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, changed or unknown, against a manifest."""
    from ..operators.joins import diff_files

    return diff_files(expected.select("path", "hash"), manifest(spark, path).select("path", "hash"))
