"""Documents stored in blocks, so that decisions travel to the texts and not the texts to the decisions.

A task packs its rows into blocks of some MB, one table row each: the rows as
compressed Arrow bytes, and beside them arrays of small values computed from the
rows (ids, fingerprints, scores). Operators work on the arrays alone, which is
a scan of these columns. What they decide comes back as row numbers of a block and is
joined to the block table, which is bucketed by block: only decisions are shuffled.

Block ids are drawn so that all blocks of a task fall into one bucket; a task so
writes one file, whatever the number of buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import new_path, partitions, released, small_batches

BLOCK_BYTES = 4 << 20
MARKS = "block long, rows array<int>"

Side = Callable[[pa.RecordBatch], dict[str, list]]


def _buckets(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit id: the engine's Murmur3 with seed 42, modulo n."""
    mask = np.uint64(0xFFFFFFFF)

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & mask

    h = np.full(len(ids), 42, np.uint64)
    for part in (ids.astype(np.uint64) & mask, ids.astype(np.uint64) >> np.uint64(32)):
        k = turned(part * np.uint64(0xCC9E2D51) & mask, 15) * np.uint64(0x1B873593) & mask
        h = (turned(h ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
    h ^= np.uint64(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & mask
    h ^= h >> np.uint64(16)
    return h.astype(np.uint32).view(np.int32).astype(np.int64) % n


def block_ids(partition: int, n: int) -> Iterator[int]:
    """Ids of a task's blocks, all of one bucket of n."""
    at = partition << 40
    while True:
        ids = np.arange(at, at + 16 * n, dtype=np.int64)
        yield from ids[_buckets(ids, n) == partition % n].tolist()
        at += 16 * n


def bucketed(df: DataFrame, n: int) -> DataFrame:
    """df as a table in the shared folder whose joins on `block` move only the other side."""
    spark = df.sparkSession
    name = f"quire_blocks_{uuid.uuid4().hex}"
    path = new_path(spark, "blocks", name)
    df.write.format("parquet").option("compression", "uncompressed").option("path", path).bucketBy(n, "block").saveAsTable(name)
    return spark.table(name)


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def parts(batch: pa.RecordBatch, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes; a longer row is a slice of its own."""
    step = max(1, int(batch.num_rows * size // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * size:
            half = part.num_rows // 2
            yield from parts(part.slice(0, half), size)
            yield from parts(part.slice(half), size)
        else:
            yield part


class Stored:
    """table: block, rows, and an array per side field; schema: of the stored documents."""

    def __init__(self, table: DataFrame, schema: T.StructType, fields: list[str]):
        self.table, self.schema, self.fields = table, schema, fields

    def narrow(self) -> DataFrame:
        """(block, row, side fields) per document."""
        zipped = F.posexplode(F.arrays_zip(*self.fields)).alias("row", "_v")
        return self.table.select("block", zipped).select("block", "row", *(F.col(f"_v.{f}") for f in self.fields))

    def at(self, marks: DataFrame, run: Callable[[pa.RecordBatch, int, list[int]], pa.RecordBatch], schema: str) -> DataFrame:
        """run(the marked rows, block, their row numbers) for every block that marks (MARKS) name; columns are c0, c1, ..."""

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, block, rows in zip(batch.column("rows"), batch.column("block").to_pylist(), batch.column("marked").to_pylist(), strict=True):
                    yield run(unpacked(blob.as_buffer()).take(pa.array(rows, pa.int32())), block, rows)

        joined = self.table.select("block", "rows").join(marks.withColumnRenamed("rows", "marked").hint("shuffle_hash"), "block")
        return joined.mapInArrow(released(chosen), schema)

    def without(self, drops: DataFrame) -> DataFrame:
        """The stored documents without the rows (block, row), in their order, with all their columns."""
        names = self.schema.names

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob, gone in zip(batch.column("rows"), batch.column("gone").to_pylist(), strict=True):
                    rows = unpacked(blob.as_buffer())
                    if gone:
                        stays = np.ones(rows.num_rows, bool)
                        stays[gone] = False
                        rows = rows.filter(pa.array(stays))
                    yield rows.rename_columns(names)

        joined = self.table.select("block", "rows").join(by_block(drops).withColumnRenamed("rows", "gone").hint("shuffle_hash"), "block", "left")
        return joined.mapInArrow(released(kept), self.schema)


def by_block(rows: DataFrame) -> DataFrame:
    """(block, row) pairs as MARKS; a block has a bounded number of rows."""
    return rows.groupBy("block").agg(F.collect_list("row").alias("rows"))


def store(docs: DataFrame, inputs: dict[str, Column], side: Side, fields: dict[str, str]) -> Stored:
    """Stores docs; side gets slices with the columns c0, c1, ... of docs and then those of `inputs`, and gives a list per field (name to type)."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    width, names = len(own), list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = block_ids(TaskContext.get().partitionId(), n)
        for batch in batches:
            for part in parts(batch):
                values = side(part)
                columns = [pa.array([next(ids)], pa.int64()), pa.array([packed(part.select(range(width)))], pa.binary())]
                columns += [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), values[f] if isinstance(values[f], pa.Array) else pa.array(values[f])) for f in names]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "rows", *names])

    schema = ", ".join(["block long", "rows binary", *(f"{f} array<{t}>" for f, t in fields.items())])
    given = docs.select(*own, *(c.alias(k) for k, c in inputs.items()))
    return Stored(bucketed(given.mapInArrow(released(run), schema), n), docs.schema, names)
