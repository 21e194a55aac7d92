"""Geographic and textual views of the driver's tables, in SQL that Spark and DuckDB both read.

Only integer arithmetic and exact decimals make the coordinates, so both engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_places": """
        SELECT CAST(1000 + n_nationkey AS BIGINT) AS place_id, 'country' AS kind, n_name AS name, CAST((n_nationkey * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((n_nationkey * 104729) % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(n_nationkey * 1000 AS BIGINT) AS population, CAST(1 + n_regionkey AS BIGINT) AS region_id, CAST(NULL AS BIGINT) AS nation_id, 'wof' AS source, 0 AS level FROM nation
        UNION ALL SELECT CAST(1000000000 + s_suppkey AS BIGINT), 'poi', s_name, CAST(((s_suppkey + 11) * 7919) % 3600 AS DOUBLE) / 10 - 180, CAST(((s_suppkey + 11) * 104729) % 1700 AS DOUBLE) / 10 - 85, CAST(floor(abs(s_acctbal)) AS BIGINT), CAST(1 + n_regionkey AS BIGINT), CAST(1000 + s_nationkey AS BIGINT), 'osm', 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT CAST(2000000000 + c_custkey AS BIGINT), 'address', c_name, CAST(((c_custkey + 37) * 7919) % 3600 AS DOUBLE) / 10 - 180, CAST(((c_custkey + 37) * 104729) % 1700 AS DOUBLE) / 10 - 85, CAST(floor(abs(c_acctbal)) AS BIGINT), CAST(1 + n_regionkey AS BIGINT), CAST(1000 + c_nationkey AS BIGINT), 'oa', 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_named": """
        SELECT place_id, kind, concat(name, ' ', p_name) AS name, lon, lat, population, region_id, nation_id, level FROM v_places JOIN part ON p_partkey = (place_id * 31) % 200""",
    "v_box": """
        SELECT CAST(1000 + n_nationkey AS BIGINT) AS place_id, 'region' AS kind, n_name AS name, CAST(n_nationkey * 144 AS DOUBLE) / 10 - 180 AS x0, CAST(-60 AS DOUBLE) AS y0, CAST(n_nationkey * 144 + 144 AS DOUBLE) / 10 - 180 AS x1, CAST(60 AS DOUBLE) AS y1, CASE WHEN n_nationkey IN (3, 7) THEN 'L' WHEN n_nationkey = 5 THEN 'O' ELSE 'B' END AS shape FROM nation
        UNION ALL SELECT CAST(1 + r_regionkey AS BIGINT), 'country', r_name, CAST(r_regionkey * 72 - 180 AS DOUBLE), CAST(-70 AS DOUBLE), CAST(r_regionkey * 72 - 108 AS DOUBLE), CAST(70 AS DOUBLE), 'B' FROM region""",
    "v_points": """
        SELECT place_id AS qid, lon, lat FROM v_places WHERE kind = 'poi'""",
    "v_buildings": """
        SELECT concat('b', CAST(s_suppkey AS STRING)) AS id, x0, y0, x0 + w AS x1, y0 + w AS y1, s_acctbal AS height, CASE WHEN s_suppkey % 3 = 0 THEN 'L' ELSE 'B' END AS shape
        FROM (SELECT s_suppkey, s_acctbal, CAST(((s_suppkey + 11) * 7919) % 3600 AS DOUBLE) / 10 - 180 - CAST(s_suppkey % 4 AS DOUBLE) / 4 AS x0, CAST(((s_suppkey + 11) * 104729) % 1700 AS DOUBLE) / 10 - 85 - CAST(s_suppkey % 5 AS DOUBLE) / 4 AS y0, CAST(1 + s_suppkey % 2 AS DOUBLE) AS w FROM supplier) s""",
    "v_dups": """
        SELECT place_id * 2 AS input_ord, kind, name, lon, lat, source, population % 3 AS depth FROM v_places
        UNION ALL SELECT place_id * 2 + 1, kind, upper(name), lon + 0.0005, lat, 'overture', CAST(2 AS BIGINT) FROM v_places WHERE place_id % 2 = 0""",
    "v_ways": """
        SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey AS node_id FROM lineitem""",
    "v_nodes": """
        SELECT p_partkey AS id, CAST((p_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((p_partkey * 104729) % 17000 AS DOUBLE) / 100 - 85 AS lat FROM part WHERE p_partkey % 11 <> 0""",
    "v_parent": """
        SELECT CAST(1 + r_regionkey AS BIGINT) AS id, CASE WHEN r_regionkey = 4 THEN CAST(1004 AS BIGINT) END AS parent_id, r_name AS name FROM region
        UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), n_name FROM nation
        UNION ALL SELECT CAST(2000000000 + c_custkey AS BIGINT), CAST(1000 + c_nationkey AS BIGINT), c_name FROM customer""",
    "v_ops": """
        SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action, CASE user_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS kind, user_id % 50 AS id, event_id AS version, CAST((event_id * 7919) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((event_id * 104729) % 1700 AS DOUBLE) / 10 - 85 AS lat, CASE WHEN event_type = 'click' THEN 'name' WHEN event_type = 'view' THEN 'note' ELSE 'shop' END AS tag FROM events""",
    "v_addr": """
        SELECT c_custkey AS qid, CASE c_custkey % 4
            WHEN 0 THEN concat(CAST(c_custkey AS STRING), ' ', c_mktsegment, ' St, ', CAST(10000 + c_custkey AS STRING), ' ', n_name, ', ', r_name)
            WHEN 1 THEN concat(c_mktsegment, ' Ave., ', r_name, ', ', n_name, ', Utopia')
            WHEN 2 THEN concat(CAST(c_custkey AS STRING), 'B ', c_mktsegment, ' blvd , , ', CAST(100 + c_custkey % 800 AS STRING), 'x ', n_name)
            ELSE concat(' ', r_name, ' ') END AS q
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_years": """
        SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat(CAST(1000 + event_id % 1000 AS STRING), '-09-01') WHEN 2 THEN concat('before ', CAST(event_id AS STRING)) WHEN 3 THEN concat(CAST(event_id AS STRING), ' BC') WHEN 4 THEN concat('ca. ', CAST(event_id AS STRING), 'bc') WHEN 5 THEN concat('circa ca.', CAST(event_id AS STRING)) WHEN 6 THEN concat(' C. ', CAST(event_id AS STRING), ' ') WHEN 7 THEN 'unknown' ELSE '' END AS raw FROM events""",
    "v_text": """
        SELECT doc_id AS id, lang, text AS raw FROM documents""",
    "v_queries": """
        SELECT CAST(s_suppkey AS BIGINT) AS qid, concat(CASE s_suppkey % 3 WHEN 0 THEN 'red ' WHEN 1 THEN 'Supplier ' ELSE 'small blue ' END, p_name) AS q, CASE WHEN s_suppkey % 2 = 0 THEN 'poi' ELSE 'address' END AS layer, CAST(s_suppkey % 90 AS DOUBLE) AS focus_lon, CAST(s_suppkey % 45 AS DOUBLE) AS focus_lat FROM supplier JOIN part ON p_partkey = s_suppkey""",
}


def needed(text: str) -> list[str]:
    """Views that a text uses, those they use first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text) and name not in out:
            out += [x for x in [*needed(VIEWS[name]), name] if x not in out]
    return out


def duck(text: str) -> str:
    """A query on views as DuckDB SQL."""
    names = needed(text)
    with_ = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not names:
        return text
    text = text.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {with_}, {text[14:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {with_}, {text[5:]}"
    return f"WITH {with_} {text}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = duck(f"SELECT * FROM {name}")
    used = [t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def polygon_sql() -> str:
    """Spark SQL: the polygon of a row of ``v_box``: a box, an L (upper right quarter missing) or a box with a hole (its middle half)."""
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    mx, my = "(x0 + x1) / 2", "(y0 + y1) / 2"
    box = f"array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('x1', 'y1')}, {p('x0', 'y1')}, {p('x0', 'y0')})"
    ell = f"array({p('x0', 'y0')}, {p('x1', 'y0')}, {p('x1', my)}, {p(mx, my)}, {p(mx, 'y1')}, {p('x0', 'y1')}, {p('x0', 'y0')})"
    qx0, qx1, qy0, qy1 = "x0 + (x1 - x0) / 4", "x1 - (x1 - x0) / 4", "y0 + (y1 - y0) / 4", "y1 - (y1 - y0) / 4"
    hole = f"array({p(qx0, qy0)}, {p(qx0, qy1)}, {p(qx1, qy1)}, {p(qx1, qy0)}, {p(qx0, qy0)})"
    return f"CASE shape WHEN 'L' THEN array(array({ell})) WHEN 'O' THEN array(array({box}, {hole})) ELSE array(array({box})) END"


def admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_box`` with polygons, as admin features."""
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, "v_box")
    return rows.select("place_id", F.lit(0).alias("level"), "kind", "name", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat"), F.array().cast("array<long>").alias("admin_path"), F.lit("osm").alias("source"), F.expr(polygon_sql()).alias("polygon"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_buildings`` with rings."""
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, "v_buildings")
    ring = F.expr(polygon_sql())[0][0]
    return rows.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat"), F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), F.col("x1").alias("max_x"), F.col("y1").alias("max_y"), ring.alias("outer_ring"), "height")


def places(spark: SparkSession, sf_dir: str, name: str = "v_places") -> DataFrame:
    """A view of places with names, admin path and tags as the data model has them."""
    from pyspark.sql import functions as F

    rows = view(spark, sf_dir, name)
    path = F.filter(F.array("region_id", "nation_id"), lambda x: x.isNotNull())
    none = F.array().cast("array<struct<key:string,value:string>>")
    return rows.select("place_id", "level", "kind", "lon", "lat", F.array(F.struct(F.lit("default").alias("lang"), F.col("name").alias("value"))).alias("names"), path.alias("admin_path"), none.alias("tags"), "population", F.concat(F.lit("x:"), F.col("place_id").cast("string")).alias("gid"))


#: DuckDB: if (px, py) is inside a row of ``v_box`` / ``v_buildings`` (half-open boxes, as rays are counted).
INSIDE = """(px >= x0 AND px < x1 AND py >= y0 AND py < y1
  AND NOT (shape = 'L' AND px >= (x0 + x1) / 2 AND py >= (y0 + y1) / 2)
  AND NOT (shape = 'O' AND px >= x0 + (x1 - x0) / 4 AND px < x1 - (x1 - x0) / 4 AND py >= y0 + (y1 - y0) / 4 AND py < y1 - (y1 - y0) / 4))"""
