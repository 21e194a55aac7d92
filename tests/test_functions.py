import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.functions import geo, ids, names, text, udfs
from wayfold.operators import search

TAGS = schema.TAGS


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first().x


def tags(**kv):
    return F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("key"), F.lit(v).alias("value")) for k, v in kv.items()]).cast(TAGS)


def test_place_ids(spark):
    assert one(spark, ids.pack_id(F.lit(1), F.lit(49509), F.lit(1))) == 2333060869803474945
    assert one(spark, ids.pack_id(F.lit(0), F.lit(49509), F.lit(1))) == 27217860589780993
    assert one(spark, ids.pack_id(F.lit(3), F.lit(0), F.lit(0))) is None and one(spark, ids.pack_id(F.lit(0), F.lit(1 << 22), F.lit(0))) is None
    x = F.lit(2333060869803474945)
    assert (one(spark, ids.id_level(x)), one(spark, ids.id_tile(x)), one(spark, ids.id_local(x))) == (1, 49509, 1)


def test_tiles(spark):
    at = lambda level, lon, lat: one(spark, ids.tile_id(F.lit(level), F.lit(lon), F.lit(lat)))
    assert [at(k, 9.5209, 47.141) for k in (0, 1, 2)] == [3107, 49509, 789878]
    assert at(1, 180.0, 90.0) == 179 * 360 + 359 and at(1, -181.0, -91.0) == 0
    assert one(spark, F.size(ids.tiles_of_bbox(F.lit(1), F.lit(9.5), F.lit(47.0), F.lit(11.5), F.lit(48.5)))) == 6
    code = lambda x, y: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(32))
    for x, y in ((0, 0), (1, 0), (0, 1), (3, 5), (1439, 719)):
        assert one(spark, ids.morton2d(F.lit(x), F.lit(y))) == code(x, y)


def test_gids(spark):
    assert one(spark, ids.synthesize_gid(F.lit("oa"), F.lit("address"), F.lit(" 7 "))) == "oa:address:7"
    assert one(spark, ids.synthesize_gid(F.lit("oa"), F.lit("address"), F.lit("  "))) is None
    gid = lambda name, lon: one(spark, ids.stable_hash_gid(F.lit("oa"), F.lit("address"), F.lit(name), F.lit(lon), F.lit(47.0)))
    assert gid(" Main ", 9.1231) == gid("main", 9.1234) != gid("main", 9.1244)


def test_haversine(spark):
    d = one(spark, geo.haversine(F.lit(9.55), F.lit(47.14), F.lit(9.555), F.lit(47.13)))
    assert d == pytest.approx(1.1745132269779712, rel=1e-12)
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None


@pytest.mark.parametrize(("raw", "year"), [("1939", 1939), ("1939-09-01", 1939), ("before 1850", 1850), ("after 1850", 1850), ("circa 1200", 1200), ("ca. 1200", 1200), ("ca.1200", 1200), ("c. 900", 900), ("1234 BC", -1234), ("44bc", -44), ("", None), ("soon", None), ("  7 ", 7)])
def test_years(spark, raw, year):
    assert one(spark, text.parse_year(F.lit(raw))) == year


@pytest.mark.parametrize(("q", "out"), [("place de la bastille", "place bastille"), ("La Place de La Bastille", "La Place La Bastille"), ("de la et", "de et"), ("kingdom of, the netherlands", "kingdom of, netherlands"), ("de la", "de la"), ("", "")])
def test_stop_words(spark, q, out):
    assert one(spark, text.drop_stop_words(F.lit(q))) == out


def test_addresses(spark):
    parse = lambda q: one(spark, text.parse_address(F.lit(q)))
    a = parse("123 W Main St, Springfield, IL 62701, USA")
    assert (a.house_number, a.road, a.city, a.country) == ("123", "W Main St", "Springfield", "USA")
    a = parse("Hauptstraße 12, 10115 Berlin, Deutschland")
    assert (a.house_number, a.road, a.postcode, a.city, a.country) == (None, "Hauptstraße 12", "10115", "Berlin", "Deutschland")
    a = parse("Aeulestrasse, Vaduz, Liechtenstein")
    assert (a.road, a.city, a.country) == ("Aeulestrasse", "Vaduz", "Liechtenstein")
    assert parse("12B Main, x").house_number == "12B" and parse("12th Ave").house_number == "12" and parse(" , ") is None
    assert one(spark, text.expand(F.lit("123 W Main St"))) == "123 west main street" and one(spark, text.expand(F.lit("5 Oak Ave., "))) == "5 oak avenue" and one(spark, text.expand(F.lit(" "))) is None


def test_trigrams_and_tokens(spark):
    assert one(spark, text.trigrams(F.lit("Zürich"))) == ["\x01zu", "zur", "uri", "ric", "ich", "ch\x01"]
    assert one(spark, text.trigrams(F.lit("--"))) == []
    assert one(spark, text.tokens(F.lit("Vaduz-42, " + "x" * 40))) == ["vaduz", "42"]
    assert one(spark, text.ngrams(F.lit("東京都"), 1, 2)) == ["東", "京", "都", "東京", "京都"]
    assert one(spark, text.prefixes(F.lit("Ab c"))) == ["a", "ab", "ab ", "ab c"]


def test_labels(spark):
    got = one(spark, text.label(F.lit("Vaduz"), F.array(F.lit("Vaduz (Li)"), F.lit("Oberland"), F.lit("Liechtenstein"))))
    assert got == "Vaduz, Oberland, Liechtenstein"


def test_categories(spark):
    cats = lambda kind, **t: one(spark, names.categories(F.lit(kind), tags(**t)))
    assert cats("poi", amenity="hospital") == ["health", "hospital"]
    assert cats("poi", shop="bakery") == ["commercial", "food", "bakery"]
    assert cats("poi", tourism="hotel") == ["accommodation", "hotel"] and cats("poi", tourism="information") == ["tourism", "information"]
    assert cats("poi", railway="station") == ["transport", "railway"] and cats("poi", railway="rail") == []
    assert cats("city") == ["admin"] and cats("postcode") == ["postal"] and cats("poi", amenity="bench") == ["bench"]


def test_names(spark):
    made = one(spark, names.collect_names(tags(name="A", name__de="B", name__x__y="C", other="D")))
    assert [(n.lang, n.value) for n in made] == [("default", "A"), ("de", "B")]
    assert one(spark, names.primary_name_lc(F.array(F.struct(F.lit("de").alias("lang"), F.lit("X").alias("value")), F.struct(F.lit("default").alias("lang"), F.lit("Y").alias("value"))))) == "y"
    assert one(spark, names.primary_name_lc(F.array().cast(schema.NAMES))) == ""


def test_fold():
    assert udfs.fold("Zürich") == "Zurich" and udfs.fold("Straße") == "Strasse" and udfs.fold("Москва") == "Moskva" and udfs.fold("Αθηνα") == "Athena" and udfs.fold("Łódź") == "Lodz"
    assert udfs.fold("東京") == "東京"


@pytest.mark.parametrize(("a", "b"), [("Müller", "Mueller"), ("Smith", "Smyth"), ("Smithsonian", "Smythsonian"), ("Catherine", "Katherine")])
def test_phonetic_pairs(a, b):
    assert set(udfs.phonetic(a)) & set(udfs.phonetic(b))


def test_double_metaphone():
    for word, codes in {"Thumb": ("0M", "TM"), "Schmidt": ("XMT", "SMT"), "Jose": ("HS", "HS"), "Knight": ("NT", "NT"), "Philips": ("FLPS", "FLPS"), "": ("", "")}.items():
        assert udfs.double_metaphone(word) == codes, word


def test_edit_distances():
    for a, b, d in (("vaduz", "vbduz", 1), ("vaduz", "vaaduz", 1), ("vaduz", "vauz", 1), ("vaduz", "avduz", 1), ("vaduz", "tokyo", 5), ("", "ab", 2)):
        assert udfs.osa(a, b) == d
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in "ab")
        assert udfs.osa(a, b) == udfs.osa(b, a) and udfs.osa(a, b) >= abs(len(a) - len(b))


def test_fuzzy_clamp(spark):
    for word, d in (("abc", 0), ("abcd", 1), ("abcde", 1), ("abcdef", 2)):
        assert one(spark, text.fuzzy_distance(F.lit(word), F.lit(2))) == d and one(spark, text.fuzzy_distance(F.lit(word), F.lit(1))) == min(1, d)


def test_deletions_meet_within_distance(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(40)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    keys = {r.w: set(r.k) for r in df.select("w", search.deletions(F.col("w"), 2).alias("k")).collect()}
    for a, b in itertools.product(words, words):
        if udfs.osa(a, b) <= 2:
            assert keys[a] & keys[b]


def test_vectors(spark):
    v = udfs.embed("Vienna")
    assert math.isclose(float((v * v).sum()), 1.0) and not udfs.embed(" ").any() and udfs.embed("vienna").tolist() == v.tolist()
    assert one(spark, search.semantic_boost(F.lit(0.2))) == 1.0 and one(spark, search.semantic_boost(F.lit(1.0))) == pytest.approx(1.6)


SQUARE = "array(array(array({})))"


def ring(*points):
    return "array(" + ", ".join(f"named_struct('x', {float(x)}D, 'y', {float(y)}D)" for x, y in points) + ")"


def test_point_in_polygon_grid(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
    df = spark.sql(f"SELECT array(array({ring(*outer)}, {ring(*hole)})) AS p, i - 3 + 0.13D AS x, j - 3 + 0.27D AS y FROM (SELECT explode(sequence(0, 16)) AS i), (SELECT explode(sequence(0, 16)) AS j)")
    for r in df.select("x", "y", F.expr(geo.in_polygon("p", "x", "y")).alias("hit")).collect():
        inside = lambda lo, hi: lo < r.x < hi and lo < r.y < hi
        assert r.hit == (inside(0, 10) and not inside(4, 6))
    ell = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))
    hit = lambda x, y: spark.sql(f"SELECT {geo.in_ring(ell, f'{x}D', f'{y}D')} AS x").first().x
    assert hit(0.25, 0.25) and not hit(0.75, 0.75) and not hit(2, 0.5)
    c = spark.sql(f"SELECT {geo.ring_centroid(ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))} AS c").first().c
    assert (c.lon, c.lat) == (1.0, 1.0)
    c = spark.sql(f"SELECT {geo.ring_centroid(ring((0, 0), (2, 2), (0, 0)))} AS c").first().c
    assert (c.lon, c.lat) == (1.0, 1.0)


def test_wkb():
    import struct

    p = struct.pack("<BIdd", 1, 1, 9.5, 47.1)
    assert udfs.wkb_point_of(p) == (9.5, 47.1) and udfs.wkb_point_of(struct.pack(">BIdd", 0, 1, 9.5, 47.1)) == (9.5, 47.1)
    assert udfs.wkb_point_of(struct.pack("<BIIdd", 1, 0x20000001, 4326, 9.5, 47.1)) == (9.5, 47.1)
    assert udfs.wkb_point_of(p[:10]) is None and udfs.wkb_point_of(struct.pack("<BI", 1, 2)) is None and udfs.wkb_point_of(None) is None
    poly = struct.pack("<BII", 1, 3, 1) + struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    assert udfs.wkb_polygons_of(poly) == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]
    assert udfs.wkb_polygons_of(struct.pack("<BII", 1, 6, 1) + poly) == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]] and udfs.wkb_polygons_of(p) is None


def test_simplify():
    ring_ = [(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert udfs.simplified(ring_, 0.01) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)] and udfs.simplified(ring_, 0) == ring_
