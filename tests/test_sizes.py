"""What failed on larger tables, on small ones: keys beyond a SQL's bits, plans that replicate what grows."""

import pytest

from wayfold.operators import search, spatial
from wayfold.plans.registry import queries


def test_morton_query_interleaves_the_bits_of_its_sql(spark, tmp_path):
    rows = [(key, size) for key in (0, 5, (1 << 20) - 1, 1 << 20, (1 << 20) + 5, 1_199_999) for size in (1, 50)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    code = lambda x, y: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(20))
    assert sorted((r.p_partkey, r.code) for r in queries()["N3_morton"](spark, str(tmp_path)).collect()) == sorted((x, code(x, y)) for x, y in rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_building_tiles_are_not_broadcast(spark, tmp_path):
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    # Wide ones lie in many tiles; ids repeat with another box, with the same box and height, and are null.
    rows = [("a", 0.0, 0.0, 9.0, 1.5), ("a", 2.0, 2.0, 3.0, 2.5), ("b", 1.0, 1.0, 1.0, 3.5), ("b", 1.0, 1.0, 1.0, 3.5), (None, 1.0, 1.0, 2.0, 4.5)]
    buildings = spark.createDataFrame([(i, x, y, x + w, y + w, h, ring(x, y, w)) for i, x, y, w, h in rows], "id string, min_x double, min_y double, max_x double, max_y double, height double, outer_ring array<struct<x: double, y: double>>")
    buildings.write.parquet(f"{tmp_path}/buildings")
    buildings = spark.read.parquet(f"{tmp_path}/buildings")  # a file that Spark takes for small
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.5, 2.5), (3, 50.0, 1.0)], "qid long, lon double, lat double")
    for strict in (True, False):
        found = spatial.buildings_at(points, buildings, strict)
        assert "BroadcastExchange" not in _plan(found)
        got = sorted(((r.qid, r["rank"], r.id or "", r.height) for r in found.collect()))
        assert got == [(1, 1, "b", 3.5), (1, 2, "b", 3.5), (1, 3, "", 4.5), (1, 4, "a", 1.5), (2, 1, "", 4.5), (2, 2, "a", 2.5), (2, 3, "a", 1.5)]


def test_attaching_buildings_broadcasts_no_tiles(spark, tmp_path):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D), named_struct('x', 0D, 'y', 9D), named_struct('x', 0D, 'y', 0D))"
    spark.range(1).selectExpr("'b' AS id", "0D AS min_x", "0D AS min_y", "9D AS max_x", "9D AS max_y", "2.25D AS height", f"{ring} AS outer_ring").write.parquet(f"{tmp_path}/buildings")
    spark.range(2).selectExpr("id AS place_id", "id * 20D + 1 AS lon", "1D AS lat", "array(named_struct('key', 'shop', 'value', 'yes')) AS tags").write.parquet(f"{tmp_path}/places")
    places, buildings = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("places", "buildings")]
    once = spatial.attach_buildings(places, buildings)
    assert "BroadcastExchange" not in _plan(once)
    tags = {r.place_id: [tuple(t) for t in r.tags] for r in spatial.attach_buildings(once, buildings).collect()}
    assert tags == {0: [("shop", "yes"), ("building_id", "b"), ("building_height", "2.3")], 1: [("shop", "yes")]}


#: Searches that failed at size with a row for each query and place.
SEARCHES = "F2_category_filter X3_autocomplete F4_bbox X14_language_boost X15_semantic_search X16_geo_bias X17_ranked_search X18_explain X19_labels X25_federated X26_pelias X2_search X6_phonetic_search X7_layer_filter".split()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 120 suppliers, all of them queries, and 400 customers; parts have 6 names."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.range(4).selectExpr("CAST(id AS INT) AS r_regionkey", "concat('REGION', id) AS r_name").write.parquet(f"{folder}/region.parquet")
    spark.range(5).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('NATION', id) AS n_name", "CAST(id % 4 AS INT) AS n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.range(120).selectExpr("id AS s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) AS s_name", "CAST(id % 5 AS INT) AS s_nationkey", "id * 1.5D AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(400).selectExpr("id AS c_custkey", "concat('Customer#', lpad(id, 9, '0')) AS c_name", "CAST(id % 5 AS INT) AS c_nationkey", "id * 1.5D AS c_acctbal").write.parquet(f"{folder}/customer.parquet")
    spark.range(200).selectExpr("id AS p_partkey", "concat(array('small', 'hot')[id % 2], ' ', array('bolt', 'ring', 'gear')[id % 3]) AS p_name").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", SEARCHES)
def test_no_row_for_each_query_and_place(spark, many, monkeypatch, name):
    made, summed = [], search.summed

    def counting(asked, index):
        out = summed(asked, index)
        made.append(out.count())
        return out

    monkeypatch.setattr(search, "summed", counting)
    found = queries()[name](spark, many).groupBy("qid").count().collect()
    assert made and sum(made) < 120 * 520 / 10
    assert len(found) == 120
