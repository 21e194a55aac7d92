"""Cross-source de-duplication of places and of admin features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, ids, names
from ..scratch import materialize

RADIUS_M = 150.0
#: Degrees of latitude that are more than the radius; nearer to the poles than ``_POLAR`` all longitudes are near each other.
_LAT_CELL = 0.0015
_POLAR = 89.9
GROUP_ROWS = 20_000


def _priority(priority: Sequence[str]):
    """Place in the list; sources that are not in it come last."""
    out = None
    for i, s in enumerate(priority):
        out = F.when(F.col("source") == s, i) if out is None else out.when(F.col("source") == s, i)
    return F.lit(len(priority)) if out is None else out.otherwise(len(priority))


def union_sources(**sources: DataFrame) -> DataFrame:
    """All sources, each row with its source's name and a number that keeps the order of arguments first."""
    out = None
    for k, (name, df) in enumerate(sources.items()):
        rows = df.withColumn("source", F.lit(name)).withColumn("input_ord", F.lit(k).cast("long") * (1 << 40) + F.coalesce(F.col("input_ord"), F.lit(0)) if "input_ord" in df.columns else F.lit(k).cast("long") * (1 << 40) + F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return materialize(out, "sources")  # a stage that is run again would number rows anew


def _runs(rows: DataFrame, keys: list[str], cell: str, name: str) -> DataFrame:
    """Adds ``name``: the number of the run of neighbouring values of ``cell`` within ``keys``; a gap of two or more parts runs."""
    order = Window.partitionBy(*keys).orderBy(cell)
    new = (F.col(cell) - F.lag(cell, 1).over(order) > 1).cast("int")
    return rows.select(*keys, cell).distinct().withColumn("_new", new).withColumn(name, F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _near_groups(rows: DataFrame) -> DataFrame:
    """Adds ``lat_run, lon_run``: rows of one (kind, name) that a chain of neighbouring grid rows, then columns, links.

    Places within the radius differ by at most one cell either way, so a gap parts groups that the greedy pass can
    never join. It keeps a name that is everywhere, or all along one parallel, from ending in one group. A column is as wide as the
    radius at the run's highest latitude; the columns go round the globe, so the last run is the first if it touches it.
    """
    key = ["kind", "name_lc"]
    rows = rows.withColumn("lat_cell", F.floor(F.col("lat") / _LAT_CELL))
    rows = rows.join(_runs(rows, key, "lat_cell", "lat_run"), [*key, "lat_cell"])
    key = [*key, "lat_run"]
    high = rows.groupBy(*key).agg(F.max(F.abs("lat")).alias("high"), F.count("*").alias("size"))
    width = F.when(F.col("high") < _POLAR, _LAT_CELL / F.cos(F.radians(F.least(F.col("high"), F.lit(_POLAR))))).otherwise(360.0)
    cells = F.floor(360 / F.col("width")).cast("long")  # columns a little wider than the radius, a whole number of them
    rows = rows.join(high, key).withColumn("width", width).withColumn("lon_cell", F.least(F.floor((F.col("lon") + 180) / 360 * cells), cells - 1)).withColumn("cells", cells)
    runs = _runs(rows, key, "lon_cell", "lon_run")
    ends = rows.groupBy(*key).agg(F.min("lon_cell").alias("first"), F.max("lon_cell").alias("last"), F.max("cells").alias("cells"))
    last = runs.groupBy(*key).agg(F.max("lon_run").alias("last_run"))
    runs = runs.join(ends.join(last, key), key).withColumn("lon_run", F.when((F.col("lon_run") == F.col("last_run")) & (F.col("first") + F.col("cells") - F.col("last") <= 1), F.lit(0)).otherwise(F.col("lon_run")))
    return rows.drop("cells", "width", "high", "size").join(runs.select(*key, "lon_cell", "lon_run"), [*key, "lon_cell"])


def greedy(rows: list[tuple], radius_m: float) -> list[int]:
    """The winners' ``input_ord``; rows in that order: ``input_ord, lon, lat, rank, depth, n_names``.

    Each row left takes all later ones within the radius. Rows are filed in cells as wide as the radius, so each looks
    at its neighbours alone.
    """
    if len(rows) == 1:
        return [rows[0][0]]
    points = [(math.radians(x), math.radians(y)) for _, x, y, *_ in rows]
    high = max(abs(r[2]) for r in rows)
    around = max(1, int(360 / (_LAT_CELL / math.cos(math.radians(high))))) if high < _POLAR else 1
    cell = lambda r: (math.floor(r[2] / _LAT_CELL), min(around - 1, int((r[1] + 180) / 360 * around)))
    filed: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(rows):
        filed.setdefault(cell(r), []).append(i)
    gone, kept = [False] * len(rows), []
    for i, r in enumerate(rows):
        if gone[i]:
            continue
        y, x = cell(r)
        winner, (lon, lat) = i, points[i]
        near = {(y + dy, (x + dx) % around) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
        for j in sorted(j for c in near for j in filed.get(c, ()) if j > i and not gone[j]):
            h = math.sin((points[j][1] - lat) / 2) ** 2 + math.cos(lat) * math.cos(points[j][1]) * math.sin((points[j][0] - lon) / 2) ** 2
            if 2 * geo.R_DEDUP_M * math.asin(min(1.0, math.sqrt(h))) <= radius_m:
                gone[j] = True
                if (-rows[j][3], *rows[j][4:]) > (-rows[winner][3], *rows[winner][4:]):
                    winner = j
        for c in near:  # what is gone is not looked at again
            if c in filed:
                filed[c] = [j for j in filed[c] if j > i and not gone[j]]
        kept.append(rows[winner][0])
    return kept


def dedupe_places(places: DataFrame, priority: Sequence[str] = (), radius_m: float = RADIUS_M) -> DataFrame:
    """Greedy clusters: the first row left (by ``input_ord``) takes all later ones of its kind and primary name within the radius.

    Of a cluster, the source that comes first in ``priority`` wins, then the longer admin
    path, then more names, then the order of input. ``places`` needs ``kind, names, lon, lat,
    source, admin_path, input_ord`` (numbers that a recomputed stage gives again); the winners' rows come back.
    Rows of a key stream through a task in order, whatever the number of keys; a key with more than ``GROUP_ROWS`` rows is
    first parted where its places leave gaps, which changes nothing in the result.
    """
    if radius_m > RADIUS_M:
        raise ValueError(f"{radius_m} m; the grid is made for {RADIUS_M} at most")
    key = places.select("input_ord", "kind", names.primary_name_lc(F.col("names")).alias("name_lc"), "lon", "lat", _priority(priority).alias("rank"), F.greatest(F.coalesce(F.size("admin_path"), F.lit(0)), F.lit(0)).alias("depth"), F.greatest(F.size("names"), F.lit(0)).alias("n_names"))
    group = ["kind", "name_lc", "lat_run", "lon_run"]
    whole = {"lat_run": F.lit(0).cast("long"), "lon_run": F.lit(0).cast("long")}
    hot = key.groupBy("kind", "name_lc").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("kind", "name_lc")
    if hot.isEmpty():
        rows = key.withColumns(whole)
    else:
        hot = materialize(hot, "hot")
        key = materialize(key, "keys")
        parted = _near_groups(materialize(key.join(hot, ["kind", "name_lc"], "left_semi"), "hot_rows"))
        rows = key.join(hot, ["kind", "name_lc"], "left_anti").withColumns(whole).unionByName(parted.drop("lat_cell", "lon_cell"))
    laid = rows.select(*group, "input_ord", "lon", "lat", "rank", "depth", "n_names").repartition(*group).sortWithinPartitions(*group, "input_ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            won: list[int] = []
            for *of, ord_, lon, lat, rank, depth, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != now:
                    if held:
                        won += greedy(held, radius_m)
                    now, held = of, []
                held.append((ord_, lon, lat, rank, depth, n))
            yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], ["input_ord"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(greedy(held, radius_m), pa.int64())], ["input_ord"])

    return places.join(laid.mapInArrow(run, "input_ord long"), "input_ord", "left_semi")


def dedupe_admin(features: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """One feature of a kind in a grid cell of a thousandth of a degree: first source, then longer admin path, then longer name, then first in."""
    order = Window.partitionBy("kind", "_x", "_y").orderBy("_rank", F.desc("_depth"), F.desc("_bytes"), "input_ord")
    rows = features.withColumns({"_x": ids.quantize(F.col("lon")), "_y": ids.quantize(F.col("lat")), "_rank": _priority(priority), "_depth": F.greatest(F.coalesce(F.size("admin_path"), F.lit(0)), F.lit(0)), "_bytes": F.octet_length("name")})
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_x", "_y", "_rank", "_depth", "_bytes", "_n")


def assign_local_ids(places: DataFrame, *order: str) -> DataFrame:
    """``place_id`` from level, tile and a running number in the tile, in the order of content."""
    rows = places.withColumn("tile_id", ids.tile_id(F.col("level"), F.col("lon"), F.col("lat")))
    local = F.row_number().over(Window.partitionBy("level", "tile_id").orderBy(*order, F.floor(F.col("lon") * 1e6), F.floor(F.col("lat") * 1e6))) - 1
    return rows.withColumn("local_id", local).withColumn("place_id", ids.pack_id(F.col("level"), F.col("tile_id"), F.col("local_id")))
