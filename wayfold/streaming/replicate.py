"""Incremental updates from a landing folder of numbered change files, by Structured Streaming.

Each micro-batch takes at most ``most`` files; the checkpoint is the record of what is
applied, so a batch runs again until its output is written, and its output is a pure
function of the batch (folders are named by batch number and overwritten).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import dirty_tiles, latest_versions
from ..schema import TAGGABLE
from ..sources.binary import osc_operations

FILES = "path string, modificationTime timestamp, length long, content binary"


def contiguous(files: DataFrame, last_applied: int, most: int = 60) -> DataFrame:
    """Files to apply next: numbered on from the last applied without a gap, ``most`` at most. files: ``seq`` and more."""
    order = Window.orderBy("seq")  # a row a file: a listing, not data
    rows = files.where(F.col("seq") > last_applied).withColumn("_k", F.row_number().over(order))
    return rows.where((F.col("seq") == F.col("_k") + last_applied) & (F.col("_k") <= most)).drop("_k")


def histogram(ops: DataFrame) -> DataFrame:
    """``kind, action, n, taggable``."""
    taggable = F.exists("tags", lambda t: t["key"].isin(TAGGABLE))
    return ops.groupBy("kind", "action").agg(F.count("*").alias("n"), F.sum(F.coalesce(taggable, F.lit(False)).cast("long")).alias("taggable"))


def apply_versions(state: DataFrame | None, ops: DataFrame) -> DataFrame:
    """The latest version of every object after the operations; a deletion stays as a row, so that an older version cannot come back."""
    rows = ops if state is None else state.unionByName(ops, allowMissingColumns=True)
    order = Window.partitionBy("kind", "id").orderBy(F.desc("version"), F.desc("seq"), F.desc("pos"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def sequence(files: DataFrame) -> DataFrame:
    """``seq`` of change files by ``path``: the number that the file's name ends with."""
    return files.select(F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("long").alias("seq")).where("seq IS NOT NULL")


def applied(spark: SparkSession, out: str) -> DataFrame:
    """``seq`` of all files that are applied."""
    try:
        return spark.read.schema("seq long").parquet(f"{out}/applied")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "seq long")


def gap(seqs: list[int], last: int | None) -> int | None:
    """The first number that is missing among files to apply, after the last applied."""
    at = last
    for s in sorted(seqs):
        if at is not None and s > at + 1:
            return at + 1
        at = s if at is None else max(at, s)
    return None


def replicate(spark: SparkSession, landing: str, out: str, checkpoint: str, most: int = 60, dry_run: bool = False):
    """Applies all files that have landed, then stops; returns the finished query.

    Writes, by batch: the operations' histogram, the dirty tiles, the versions, and the numbers applied. A batch fails if, up to its last number, one
    that is not applied has not landed; it is tried again by the next run. Versions decide, so a file that comes late or twice does no harm.
    dry_run: reads and counts what is not applied yet, but leaves the checkpoint alone (a batch read of the folder).
    """
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.osc*").option("maxFilesPerTrigger", most).load(landing)

    def batch(files: DataFrame, number: int) -> None:
        seqs = sequence(files)
        last, top = applied(spark, out).agg(F.max("seq")).first()[0], seqs.agg(F.max("seq")).first()[0]
        landed = sequence(spark.read.format("binaryFile").option("pathGlobFilter", "*.osc*").load(landing).select("path"))  # a listing: no content is read
        landed = landed.where(F.lit(True) if last is None else F.col("seq") > last).where(F.col("seq") <= top)
        if top is not None and (missing := gap([r.seq for r in landed.collect()], last)) is not None:
            raise ValueError(f"change file {missing} is missing")
        ops = osc_operations(files.select("path", "content")).persist()
        histogram(ops).write.mode("overwrite").parquet(f"{out}/histogram/batch={number}")
        dirty_tiles(ops).write.mode("overwrite").parquet(f"{out}/dirty_tiles/batch={number}")
        apply_versions(None, ops).write.mode("overwrite").parquet(f"{out}/versions/batch={number}")
        seqs.write.mode("overwrite").parquet(f"{out}/applied/batch={number}")
        ops.unpersist()

    if dry_run:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.osc*").load(landing).select("path", "content")
        files = files.withColumn("seq", F.regexp_extract("path", r"([0-9]+)[^/]*$", 1).try_cast("long")).join(applied(spark, out), "seq", "left_anti")
        return histogram(osc_operations(files.select("path", "content")))
    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, out: str) -> DataFrame:
    """Objects as they are after all batches, deletions left out."""
    return latest_versions(spark.read.parquet(f"{out}/versions").drop("batch"))


def status(last_fetched: int, last_applied: int) -> dict[str, int]:
    return {"last_fetched": last_fetched, "last_applied": last_applied, "lag": last_fetched - last_applied}
