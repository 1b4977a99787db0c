"""Incremental ingest: what has been processed is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(found: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the manifest does not have."""
    return found.join(manifest.select(*keys).distinct(), keys, "left_anti")


def upload_status(names: DataFrame, existing: DataFrame, extensions: list[str]) -> DataFrame:
    """(name, status): skipped for other extensions, overwritten if the name exists, else saved."""
    ok = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(extensions)
    marked = names.join(existing.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    return marked.select("name", F.when(~ok, "skipped").when(F.col("there"), "overwritten").otherwise("saved").alias("status"))


def watch_pages(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, once: bool = True):
    """A stream from new JSON-lines files under `source` to Parquet under `target`; the checkpoint holds what was read."""
    rows = spark.readStream.schema(schema).json(source)
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
