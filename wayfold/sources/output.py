"""Result formats: an envelope a query, newline-delimited JSON, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence


def feature(row: list[str], lon: str = "lon", lat: str = "lat") -> Column:
    """A GeoJSON feature of a row: a point, and the named columns as properties."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*row).alias("properties"))


def feature_collections(hits: DataFrame, properties: list[str]) -> DataFrame:
    """``qid, body``: one GeoJSON FeatureCollection a query, features by rank, each with its confidence. A query has 100 hits at most."""
    rows = hits.withColumn("confidence", confidence(F.col("score"))).withColumn("f", feature([*properties, "confidence"]))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))), lambda x: x["f"])
    return rows.groupBy("qid").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), listed.alias("features"))).alias("body"))


def envelopes(hits: DataFrame, columns: list[str]) -> DataFrame:
    """``qid, body``: one JSON object a query with its results by rank."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("r")))), lambda x: x["r"])
    return hits.groupBy("qid").agg(F.to_json(F.struct(listed.alias("results"))).alias("body"))


def ndjson(hits: DataFrame, columns: list[str]) -> DataFrame:
    """``value``: one line a hit, in the order of query and rank when written sorted."""
    return hits.orderBy("qid", "rank").select(F.to_json(F.struct(*columns)).alias("value"))
