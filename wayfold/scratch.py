"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='wayfold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wayfold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to a scratch path and reads it back: lineage ends there."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
