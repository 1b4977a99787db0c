"""Shared storage and input shaping for the operators here.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` so that
any executor can reread them after another one is lost; only where the setting
is missing (local tests) a temporary folder is used. Results are lazy and read
them, so they stay until `cleanup` is called, at the latest when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: str | None = None
#: What was written and not removed yet: folders, each with the name of its table, if it has one.
_written: dict[str, str | None] = {}
#: Lists that want to know of what is written.
_notes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("notes", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _fallback = _fallback or tempfile.mkdtemp(prefix="quire-")
    return _fallback


def new_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A folder for an intermediate result, which cleanup removes; table: the name of the table that is kept in it."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    _written[path] = table
    for notes in _notes.get():
        notes.append(path)
    return path


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The folders that this thread writes within the block."""
    notes: list[str] = []
    token = _notes.set((*_notes.get(), notes))
    try:
        yield notes
    finally:
        _notes.reset(token)


def written() -> list[str]:
    """The folders of intermediate results that are there."""
    return list(_written)


def cleanup(spark: SparkSession, paths: list[str] | None = None, read_by: DataFrame | None = None) -> None:
    """Removes intermediate tables and folders of this driver, all or some, but for those that read_by reads. Other results that are lazy yet cannot be read any more."""
    used = _roots(read_by) if read_by is not None else ""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in (_written if paths is None else paths) if p in _written and p.rsplit("/", 1)[1] not in used]:
        if table := _written.pop(path):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def _roots(df: DataFrame) -> str:
    """The folders that a plan reads, as text."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        with contextlib.suppress(Exception):  # a leaf that reads no files
            out.append(leaves.apply(k).relation().location().rootPaths().mkString(" "))
    return " ".join(out)


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may have been stopped, and its folder removed, already
            cleanup(spark)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it as a plain scan: the lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of long texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, giving back at the end of a task what its worker process no longer holds: workers idle on between stages."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lowered(col):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id, remainder: int, folds: int = 5):
    """crc32 of doc_id as text, modulo `folds`, equals `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(remainder), F.lit(False))
