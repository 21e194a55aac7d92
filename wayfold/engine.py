"""The engine: a bundle of tables, and the queries that run on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedup, search, spatial
from .schema import KINDS, reverse_class
from .sources import output


@dataclass
class Engine:
    """places, admin and buildings in the data model's schemas, and the text index of the places."""

    spark: SparkSession
    places: DataFrame
    admin: DataFrame
    index: search.Index
    buildings: DataFrame | None = None

    @classmethod
    def build(cls, spark: SparkSession, sources: dict[str, DataFrame], admin: DataFrame, buildings: DataFrame | None = None, priority: tuple[str, ...] = ()) -> Engine:
        """Union, dedup, ids, admin chains, index: one lazy plan until something is read or written."""
        places = dedup.dedupe_places(dedup.union_sources(**sources), priority)
        places = dedup.assign_local_ids(places.withColumn("_first", F.col("names")[0]["value"]), "kind", "_first").drop("_first", "local_id")
        admin = spatial.enrich_admin(admin)
        places = spatial.enrich_places(places, admin)
        return cls(spark, places, admin, search.build_index(places), buildings)

    def write(self, path: str) -> None:
        """The bundle as Parquet folders below ``path``."""
        from .sources.files import write_places, write_tiled

        write_places(self.places, f"{path}/places")
        self.admin.write.mode("overwrite").parquet(f"{path}/admin")
        self.index.write(f"{path}/index")
        if self.buildings is not None:
            write_tiled(self.buildings, f"{path}/buildings", 2)

    @classmethod
    def open(cls, spark: SparkSession, path: str, buildings: bool = False) -> Engine:
        return cls(spark, spark.read.parquet(f"{path}/places"), spark.read.parquet(f"{path}/admin"), search.Index.read(spark, f"{path}/index"), spark.read.parquet(f"{path}/buildings") if buildings else None)

    def admin_names(self) -> DataFrame:
        return self.admin.select("place_id", "name")

    def search(self, queries: DataFrame, labels: bool = False) -> DataFrame:
        """queries: ``qid, q`` and any option of ``search.OPTIONS``."""
        hits = search.search(queries, self.index)
        return search.labelled(hits, self.admin_names()) if labels else hits

    def structured(self, queries: DataFrame) -> DataFrame:
        return search.search(search.structured(queries), self.index)

    def reverse(self, points: DataFrame, limit: int = 10, near: int = 1, context: str | None = None) -> DataFrame:
        if context == "full":
            return spatial.reverse_full(points, self.admin, self.places, reverse_class(F.col("kind")))
        return spatial.reverse(points, self.admin, self.places, limit, near)

    def reload(self, path: str) -> Engine:
        """The same engine on the bundle that stands in ``path`` now; queries that run keep the tables they began with."""
        self.spark.catalog.refreshByPath(path)
        fresh = Engine.open(self.spark, path, self.buildings is not None)
        self.places, self.admin, self.index, self.buildings = fresh.places, fresh.admin, fresh.index, fresh.buildings
        return self

    def pelias_search(self, queries: DataFrame, autocomplete: bool = False) -> DataFrame:
        """``qid, body``: a GeoJSON collection a query; no fuzziness, the default weight of a focus."""
        asked = queries.drop("mode", "fuzzy", "focus_weight").withColumn("mode", F.lit("autocomplete" if autocomplete else "search"))
        return output.feature_collections(search.search(asked, self.index), ["place_id", "gid", "kind", "name"])

    def pelias_reverse(self, points: DataFrame, limit: int = 10) -> DataFrame:
        """``qid, body``: the polygons that hold each point, finest first, each with a score of 1."""
        hits = spatial.finest_first(spatial.point_in_polygon(points, self.admin), limit=limit)
        hits = hits.select("qid", "rank", "place_id", "kind", "name", F.col("centre_lon").alias("lon"), F.col("centre_lat").alias("lat"), F.lit(1.0).alias("score"))
        return output.feature_collections(hits, ["place_id", "kind", "name"])

    def buildings_at(self, points: DataFrame, strict: bool = True, limit: int = 10) -> DataFrame:
        return spatial.buildings_at(points, self.buildings, strict, limit)

    def place(self, wanted: DataFrame) -> DataFrame:
        return search.lookup(wanted, self.index)

    def layers(self) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in KINDS], "layer string")

    def info(self) -> DataFrame:
        """Places by level and kind."""
        return self.places.groupBy("level", "kind").agg(F.count("*").alias("n"))
