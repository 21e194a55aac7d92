import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.engine import Engine
from wayfold.functions.udfs import fold
from wayfold.operators import dedup, joins, search, spatial

PLACE = f"place_id long, level int, kind string, lon double, lat double, names {schema.NAMES}, admin_path array<long>, tags {schema.TAGS}"


def places(spark, *rows):
    return spark.createDataFrame([(i, 1, k, x, y, [("default", n)] if isinstance(n, str) else n, p, [tuple(t) for t in tags]) for i, k, n, x, y, p, tags in rows], PLACE)


VADUZ = (2333060869803474945, "city", "Vaduz", 9.5209, 47.141, [27217860589780993], [])
LI = (27217860589780993, "country", "Liechtenstein", 9.555, 47.13, [], [])


def hits(spark, index, q, **options):
    df = spark.createDataFrame([(1, q)], "qid long, q string").select("qid", "q", *[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in options.items()])
    return search.search(df, index).orderBy("rank").collect()


def test_golden_scores(spark):
    index = search.build_index(places(spark, VADUZ, LI))
    (r,) = hits(spark, index, "Vaduz")
    assert r.score == pytest.approx(2.7725887, abs=1e-6) and r.place_id == VADUZ[0] and r.exact_boost == 4.0 and r.bm25 == pytest.approx(math.log(2))
    q = search.structured(spark.createDataFrame([(1, " Liechtenstein ", "")], "qid long, country string, city string"))
    (r,) = search.search(q.select("qid", "q", "layers"), index).collect()
    assert r.score == pytest.approx(5.5451775, abs=1e-6) and r.place_id == LI[0]
    (r,) = search.lookup(spark.createDataFrame([(0, str(VADUZ[0])), (1, "5"), (2, str(VADUZ[0]))], "pos int, token string"), index).collect()
    assert r.score / (1 + r.score) == pytest.approx(0.4093839, abs=1e-6)
    assert hits(spark, index, "  ") == [] and hits(spark, index, "nowhere") == []


def test_fuzzy_phonetic_and_folding(spark):
    index = search.build_index(places(spark, (1, "city", "Vaduz", 9.5, 47.1, [], []), (2, "poi", "Smith Plaza", 9.5, 47.1, [], []), (3, "city", "Zürich", 8.5, 47.4, [], []), (4, "city", [("default", "東京都")], 139.7, 35.7, [], []), (5, "city", "Москва", 37.6, 55.7, [], []), (6, "poi", "Vaduz Castle", 9.5, 47.1, [], []), (7, "city", "Müller", 9.0, 47.0, [], [])))
    ids = lambda q, **o: [r.place_id for r in hits(spark, index, q, **o)]
    assert ids("Vauz", fuzzy=1)[0] == 1 and ids("Vdauz", fuzzy=1)[0] == 1 and ids("Vauz") == []
    assert ids("Vaduz Castel", fuzzy=2) == [6]  # all words must be found; a swap is one edit
    assert ids("Smyth", phonetic=True) == [2] and ids("Smyth") == [] and 7 in ids("Mueller", phonetic=True)
    assert ids("Zurich") == [3] and ids("zürich") == [3] and ids("Moskva") == [5] and ids("東京") == [4]
    assert hits(spark, index, "Zurich")[0].exact_boost == 4.0
    assert ids("vad", mode="autocomplete") == [1, 6] and ids("cas", mode="autocomplete") == []
    plain, near = hits(spark, index, "Vaduz")[0], hits(spark, index, "Vaduz", semantic=True)[0]
    assert near.semantic_boost == pytest.approx(1.6, abs=1e-6) and plain.semantic_boost == 1.0


def test_filters_and_boosts(spark):
    index = search.build_index(places(spark, (1, "poi", "Riva Center", 9.5, 47.1, [], [("amenity", "hospital")]), (2, "poi", "Riva Center", 20.0, 47.1, [], [("shop", "bakery"), ("population", "200000")]), (3, "city", [("default", "Riva"), ("de", "Reif"), ("en_alt", "Shore")], 9.6, 47.2, [], [("start_date", "1900"), ("end_date", "1950")])))
    ids = lambda q, **o: [r.place_id for r in hits(spark, index, q, **o)]
    assert ids("Riva Center", categories=["health"]) == [1] and ids("Riva Center", categories=["health", " FOOD "]) == [2, 1] and ids("riva", categories=[" "]) == ids("riva")
    assert ids("riva", layers=["locality"]) == [3] and set(ids("riva", layers=["venue"])) == {1, 2}
    assert 3 in ids("riva", valid_at=1920) and 3 not in ids("riva", valid_at=1960)
    assert ids("Riva Center")[:2] == [2, 1] and ids("Riva Center", focus_lon=9.5, focus_lat=47.1)[0] == 1
    box = {"min_x": 9.0, "min_y": 47.0, "max_x": 10.0, "max_y": 48.0}
    assert set(ids("riva", **box)) == {1, 3} and set(ids("riva", **(box | {"min_x": 11.0}))) == {1, 2, 3}
    assert hits(spark, index, "reif", lang="DE")[0].language_boost == 1.5 and hits(spark, index, "shore", lang="en")[0].language_boost == 1.5
    r = hits(spark, index, "Riva Center", focus_lon=9.5, focus_lat=47.1)[0]
    assert r.score == pytest.approx(r.bm25 * r.exact_boost * r.edit_boost * r.population_boost * r.language_boost * r.semantic_boost * r.geo_bias)


def test_dedup_places(spark):
    def rows(*items):
        return spark.createDataFrame([(i, k, x, 47.0, [("default", n)], p, s) for i, k, n, x, p, s in items], f"input_ord long, kind string, lon double, lat double, names {schema.NAMES}, admin_path array<long>, source string")

    kept = lambda df, *p: sorted(r.input_ord for r in dedup.dedupe_places(df, p).collect())
    df = rows((0, "city", "Vaduz", 9.0, [], "osm"), (1, "city", "VADUZ", 9.001, [1], "wof"), (2, "poi", "Vaduz", 9.0, [], "osm"), (3, "city", "Vaduz", 9.1, [], "osm"))
    assert kept(df) == [1, 2, 3] and kept(df, "osm") == [0, 2, 3]
    chain = rows(*[(i, "poi", "Post", 9.0 + i * 0.0015, [], "osm") for i in range(9)])  # 114 m apart: greedy takes pairs from each seed
    assert kept(chain) == [0, 2, 4, 6, 8]
    rng = random.Random(1)
    items = [(i, "poi", "P", 9.0 + rng.random() * 0.01, list(range(rng.randrange(3))), rng.choice(["a", "b"])) for i in range(60)]

    def far(a, b):
        h = math.cos(math.radians(47)) ** 2 * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h)) > 150

    left, want = list(items), []
    while left:
        group = [x for x in left if not far(left[0], x)]
        best = group[0]
        for x in group[1:]:
            if (x[5] == "b", len(x[4])) > (best[5] == "b", len(best[4])):
                best = x
        want.append(best[0])
        left = [x for x in left if x not in group]
    assert kept(rows(*items), "b") == sorted(want)


def test_crossing_edges_equal_brute_force():
    rng = random.Random(3)
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    seen = set()
    for _ in range(300):
        ring = [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(3, 8))]
        ring.append(ring[0])
        n = len(ring) - 1
        want = any(side(*ring[i : i + 2], ring[j]) * side(*ring[i : i + 2], ring[j + 1]) < 0 and side(*ring[j : j + 2], ring[i]) * side(*ring[j : j + 2], ring[i + 1]) < 0 for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))
        assert joins._crosses(ring) == want
        seen.add(want)
    assert seen == {True, False}
    circle = [(math.cos(k / 10_000 * math.tau), math.sin(k / 10_000 * math.tau)) for k in range(10_000)]
    assert not joins._crosses([*circle, circle[0]]) and joins._crosses([*circle[:5000], circle[5002], circle[5001], *circle[5003:], circle[0]]) is not None


@pytest.mark.parametrize("most", [20_000, 3])
def test_dedup_places_equals_brute_force(spark, monkeypatch, most):
    """Names along a parallel, over the date line and at a pole; groups whole and parted."""
    monkeypatch.setattr(dedup, "GROUP_ROWS", most)
    rng = random.Random(6)
    rows = []
    for name, lon, lat in (("line", None, 47.0), ("date", 180.0, 10.0), ("pole", None, 89.9995), ("far", None, None), ("one", 5.0, 5.0)):
        for _ in range(1 if name == "one" else 70):
            x = rng.random() * 0.05 if lon is None else (lon + rng.random() * 0.006 - 0.003 + 180) % 360 - 180
            x, y = (rng.random() * 360 - 180, lat) if name == "pole" else (x, (lat or 0) + rng.random() * (0.002 if lat else 0.05))
            rows.append((len(rows), "poi", x, y, [("default", name)], [1] * rng.randrange(3), rng.choice("ab")))

    def near(a, b):
        la, lb = math.radians(a[3]), math.radians(b[3])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h))) <= 150

    left, want = list(rows), []
    while left:
        group = [x for x in left if x is left[0] or x[4] == left[0][4] and near(left[0], x)]
        want.append(max(group, key=lambda x: (x[6] == "b", len(x[5]), -x[0]))[0])
        left = [x for x in left if x not in group]
    df = spark.createDataFrame(rows, f"input_ord long, kind string, lon double, lat double, names {schema.NAMES}, admin_path array<long>, source string")
    assert sorted(r.input_ord for r in dedup.dedupe_places(df, ["b"]).collect()) == sorted(want)


def test_interpolation(spark):
    def run(kind, ends, points):
        ways = spark.createDataFrame([(1, kind, None)], "way_id long, kind string, street string")
        refs = spark.createDataFrame([(1, i, i) for i in range(len(points))], "way_id long, pos int, node_id long")
        nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, lon double, lat double")
        addr = spark.createDataFrame([(0, ends[0], "S"), (len(points) - 1, ends[1], None)], "node_id long, number string, street string")
        return {r.number: (round(r.lon, 6), round(r.lat, 6)) for r in joins.interpolate(ways, refs, nodes, addr).collect()}

    assert run("odd", ("1", "11"), [(9, 47), (9, 47.5)]) == {3: (9, 47.1), 5: (9, 47.2), 7: (9, 47.3), 9: (9, 47.4)}
    assert sorted(run("even", ("12", "4"), [(9, 47), (9, 47.5)])) == [6, 8, 10] and run("even", ("12", "4"), [(9, 47), (9, 47.5)])[6] == (9, 47.375)
    assert sorted(run("all", ("1", "5"), [(9, 47), (9, 47.5)])) == [2, 3, 4]
    ell = run("odd", ("1", "11"), [(0, 0), (10, 0), (10, 10)])
    assert ell[5] == (8, 0) and ell[9] == (10, 6)
    assert run("odd", ("1", "x"), [(0, 0), (1, 0)]) == {} and run("zigzag", ("1", "9"), [(0, 0), (1, 0)]) == {} and run("odd", ("1", "3"), [(0, 0), (1, 0)]) == {}


def test_rings(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    parts = joins.polygon_of([square(0, 0, 10)[::-1], square(20, 0, 5)], [square(2, 2, 2), square(21, 1, 1), square(50, 50, 1)])
    assert [len(p) for p in parts] == [2, 2] and joins.ring_area(parts[0][0]) > 0 > joins.ring_area(parts[0][1])
    assert joins._crosses([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]) and not joins._crosses(square(0, 0, 1))
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 4.0, 4.0), (4, 0.0, 4.0), (5, 1.0, 1.0), (6, 2.0, 1.0), (7, 2.0, 2.0)], "id long, lon double, lat double")
    refs = spark.createDataFrame([(w, i, n) for w, ns in ((10, [1, 2, 3]), (11, [1, 4, 3]), (12, [5, 6, 7, 5]), (13, [1, 2])) for i, n in enumerate(ns)], "way_id long, pos int, node_id long")
    members = spark.createDataFrame([(1, 10, "outer", 0), (1, 11, "", 1), (1, 12, "inner", 2), (2, 13, "outer", 0)], "rel_id long, way_id long, role string, member_pos int")
    got = {r.rel_id: r for r in joins.assemble_relations(members, refs, nodes).collect()}
    assert len(got[1].polygon) == 1 and len(got[1].polygon[0]) == 2 and got[2].polygon is None and got[2].skipped_rings == 1


def test_nearest_is_exact(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [(1000 + i, 9.5 + i * 1e-3, 47.0) for i in range(50)] + [(2000, 9.5, 47.0)]
    qs = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(40)] + [(100, 9.5, 47.0), (101, 180.0, 90.0), (102, -180.0, -90.0)]
    got: dict = {}
    for r in spatial.nearest(spark.createDataFrame(qs, "qid long, lon double, lat double"), spark.createDataFrame(pts, "place_id long, lon double, lat double"), 4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.place_id
    for q, x, y in qs:
        want = sorted(((x - a) * (x - a) + (y - b) * (y - b), i) for i, a, b in pts)[:4]
        assert [got[q][k] for k in (1, 2, 3, 4)] == [i for _, i in want]
    few = spatial.nearest(spark.createDataFrame(qs[:2], "qid long, lon double, lat double"), spark.createDataFrame(pts[:2], "place_id long, lon double, lat double"), 4)
    assert few.count() == 4


def test_engine_end_to_end(spark, tmp_path):
    ring = [(9.45, 47.05), (9.65, 47.05), (9.65, 47.27), (9.45, 47.27), (9.45, 47.05)]
    admin = spark.createDataFrame([(LI[0], 0, "country", "Liechtenstein", 9.555, 47.13, [], "wof", [[ring]])], schema.ADMIN)
    base = places(spark, (1, "city", "Vaduz", 9.5209, 47.141, [], []), (2, "city", "Schaan", 9.5095, 47.165, [], []), (3, "street", "Weg", 9.52, 47.14, [], [])).drop("place_id").coalesce(1)
    twin = places(spark, (9, "city", "vaduz", 9.5210, 47.141, [], [])).drop("place_id")
    house = spark.createDataFrame([("b1", 9.52, 47.14, 9.5, 47.1, 9.6, 47.2, [(9.5, 47.1), (9.6, 47.1), (9.6, 47.2), (9.5, 47.2), (9.5, 47.1)], 8.5)], schema.BUILDINGS)
    built = Engine.build(spark, {"osm": base, "geonames": twin}, admin, house)
    built.write(str(tmp_path / "b"))
    e = Engine.open(spark, str(tmp_path / "b"), buildings=True)
    assert {r["name"] for r in e.index.store.collect()} == {"Vaduz", "Schaan", "Weg"} and all(r.admin_path == [LI[0]] for r in e.places.collect())
    (r,) = e.search(spark.createDataFrame([(1, "vaduz")], "qid long, q string"), labels=True).collect()
    assert r.label == "Vaduz, Liechtenstein"
    at = spark.createDataFrame([(1, 9.55, 47.14), (2, 0.0, 0.0)], "qid long, lon double, lat double")
    got = {r.qid: r for r in e.reverse(at).collect()}
    assert got[1].source == "pip" and got[1].distance_km == pytest.approx(1.1745132269779712) and got[2].source == "nearest"
    assert {(r.qid, r["class"]) for r in e.reverse(at, context="full").collect()} == {(1, "admin"), (1, "street"), (2, "street")}
    assert [(r.qid, r.id) for r in e.buildings_at(at).collect()] == [(1, "b1")]
    (r,) = e.pelias_search(spark.createDataFrame([(1, "vaduz", 2)], "qid long, q string, fuzzy int")).collect()
    assert [f["properties"]["name"] for f in json.loads(r.body)["features"]] == ["Vaduz"]
    (r,) = e.pelias_reverse(at).collect()
    assert r.qid == 1 and [(f["properties"]["place_id"], f["properties"]["confidence"]) for f in json.loads(r.body)["features"]] == [(LI[0], 0.5)]
    assert e.reload(str(tmp_path / "b")).places.count() == 3
    assert e.layers().count() == 10 and {r.n for r in e.info().collect()} == {1, 2}
    once = spatial.attach_buildings(e.places, house)
    assert sorted(map(str, once.collect())) == sorted(map(str, spatial.attach_buildings(once, house).collect()))


def test_plans_have_no_nested_loops(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    admin = spark.createDataFrame([(1, 0, "country", "A", 0.5, 0.5, [], "wof", [[ring]])], schema.ADMIN)
    at = spark.createDataFrame([(1, 0.5, 0.5)], "qid long, lon double, lat double")
    for df in (spatial.point_in_polygon(at, admin), spatial.nearest(at, at.withColumnRenamed("qid", "place_id"), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fold_is_idempotent():
    for t in ("Zürich", "Łódź", "Москва", "Straße"):
        assert fold(fold(t)) == fold(t)


def test_search_in_a_box_cuts_nothing_before_it(spark):
    """All places in the box are ranked, by a brute-force BM25, also where scores tie by their rounding and where a name is asked for exactly."""
    rng = random.Random(3)
    words, sizes = ["red", "blue", "bolt", "ring"], [0, 5, 6, 7, 10**9, 10**9 + 1, 10**9 + 2]
    rows = [(i, "place " + " ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3]))), float(rng.randrange(-9, 10)), float(rng.randrange(-9, 10)), rng.choice(sizes)) for i in range(700)]
    df = spark.createDataFrame([(i, 1, "poi", x, y, [("default", n)], [], [("population", str(p))]) for i, n, x, y, p in rows], PLACE)
    boxes = [(-1.0, -1.0, 0.0, 1.0), (2.0, -9.0, 9.0, 9.0), (2.0, 2.0, 2.0, 2.0), (3.0, 3.0, -3.0, 4.0), (None, 0.0, 1.0, 1.0)]
    texts = ["place", "red", "Place blue", "place red bolt", "ring blue"]
    queries = [(len(boxes) * t + b, q, 3 + b % 2, *box) for t, q in enumerate(texts) for b, box in enumerate(boxes)]
    names = "qid long, q string, lim int, min_x double, min_y double, max_x double, max_y double"
    index = search.build_index(df, plain=True)
    def hits(given):
        out = {}
        for r in search.search(given, index, plain=True).orderBy("qid", "rank").collect():
            out.setdefault(r.qid, []).append((r.place_id, round(r.score, 6)))
        return out

    got = hits(spark.createDataFrame(queries, names))
    mean, held = sum(len(n.split()) for _, n, *_ in rows) / len(rows), {w: sum(w in n.split() for _, n, *_ in rows) for w in ["place", *words]}
    for qid, q, lim, *box in queries:
        if qid % len(boxes) > 2:
            continue
        want = []
        for i, n, x, y, p in rows:
            own, asked = n.split(), set(q.lower().split())
            bm = sum(math.log(1 + (len(rows) - held[w] + 0.5) / (held[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in asked if w in own)
            if bm > 0 and box[0] <= x <= box[2] and box[1] <= y <= box[3]:
                want.append((bm * (4.0 if q.lower() == n else 1.0) * (1 + 0.1 * math.log10(1 + p) if p else 1.0), i))
        want = sorted(want, key=lambda s: (-round(s[0], 9), s[1]))[:lim]
        assert got.get(qid, []) == [(i, round(s, 6)) for s, i in want], (q, box)
        assert qid % len(boxes) == 2 or len(want) == lim
    free = [q for q in queries if q[0] % len(boxes) > 2]
    assert {q[0]: got[q[0]] for q in free} == hits(spark.createDataFrame(free, names).select("qid", "q", "lim"))
    # Options that tell places of a class apart take all of the box.
    far = hits(spark.createDataFrame(queries[:3], names).withColumns({"lang": F.lit("xx"), "focus_lon": F.lit(0.0), "focus_lat": F.lit(0.0), "focus_weight": F.lit(0.0)}))
    assert far == {q[0]: got[q[0]] for q in queries[:3] if q[0] in got}
