"""Where derived tables go that no caller names a place for: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def _own() -> str:
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="quire-library-")
        atexit.register(shutil.rmtree, _local, True)
    return _local


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session without that setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or _own()}/quire-library/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written once and read from there: what follows reads the same rows however often."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, new_path(df.sparkSession, name))
