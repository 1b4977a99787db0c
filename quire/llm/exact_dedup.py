"""Exact deduplication by a Golomb-coded fingerprint exchange.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
1. Rows are stored in blocks, with the XXH64 and SHA-256 of their normalised text.
2. Partitions send sorted, Golomb-coded fingerprints to owners and get bitmaps
   of duplicates back, which name the suspects of every block.
3. The bitmaps go to the blocks, and suspects alone move their text: they are
   grouped by fingerprint and bytes, combined before the shuffle, so a group of
   any size costs one row per task. Which rows go is told to the blocks again.
At no number of suspects does a text that is no suspect move.

Defined cases: null text equals an empty one. Null ids never win against an id;
a group of null ids only keeps a null id. Rows that repeat an id and text count
in group_size and are all marked kept; `deduplicated` leaves one of them.
An empty table gives an empty result. Other columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange, _rows
from ._store import keep, partitions, released

#: Fingerprints in one message of a partition.
MESSAGE = 1 << 18
SEED = 42
_SENT = f"{_exchange.SENT}, blocks array<long>, sizes array<int>, fps binary"


def _lowered(part: pa.RecordBatch, column: int) -> tuple[list[bytes], np.ndarray]:
    """The normalised texts, in UTF-8, and their fingerprints."""
    texts = [(t or b"").lower() for t in part.column(column).cast(pa.binary()).to_pylist()]
    return texts, np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)


def _stored(docs: DataFrame, doc_id: str, text: str, whole: bool) -> _rows.Stored:
    """docs with id, fp and, for `whole`, sha of each row."""
    column = docs.columns.index(text)

    def prints(part: pa.RecordBatch) -> dict[str, list]:
        texts, fps = _lowered(part, column)
        return {"id": part.column("id"), "fp": fps} | ({"sha": [hashlib.sha256(t).digest() for t in texts]} if whole else {})

    return _rows.store(docs, {"id": F.col(doc_id).cast("long")}, prints, {"id": "long", "fp": "long"} | ({"sha": "binary"} if whole else {}))


def _sender(bits: int):
    """Messages to the owners, and to itself (owner -1) a note of the blocks that a message is made from."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds = {"msg": pa.int64(), "owner": pa.int32(), "payload": pa.binary(), "own": pa.binary(), "blocks": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "fps": pa.binary()}
        schema = pa.schema(list(kinds.items()))
        msg, blocks, held = TaskContext.get().partitionId() << 32, [], []

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            values, counts = np.unique(every, return_counts=True)
            rows = _exchange.messages(msg, values, counts > 1, bits)
            more = {"msg": msg, "owner": -1, "payload": None, "own": None, "blocks": blocks, "sizes": [len(h) for h in held], "fps": every.tobytes()}
            n = len(rows["msg"])
            return pa.RecordBatch.from_pydict({c: [*rows.get(c, [None] * n), more[c]] for c in kinds}, schema=schema)

        for batch in batches:
            for block, fps in zip(batch.column("block").to_pylist(), batch.column("fp"), strict=True):
                blocks.append(block)
                held.append(fps.values.to_numpy().view(np.uint64))
                if sum(map(len, held)) >= MESSAGE:
                    yield flush()
                    msg, blocks, held = msg + 1, [], []
        if held:
            yield flush()

    return send


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that the owners' bitmaps name."""
    for batch in batches:
        for row in batch.to_pylist():
            values, inverse = np.unique(np.frombuffer(row["fps"], np.uint64), return_inverse=True)
            flags = np.zeros(len(values), bool)
            at = 0
            for reply in sorted(row["replies"], key=lambda r: r["owner"]):
                flags[at : at + reply["n"]] = _exchange.unpack(reply["bitmap"], reply["n"])
                at += reply["n"]
            ends = np.cumsum(row["sizes"])
            rows = [np.flatnonzero(part).astype(np.int32) for part in np.split(flags[inverse], ends[:-1])]
            found = [(b, r) for b, r in zip(row["blocks"], rows, strict=True) if len(r)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int32()))], names=["block", "rows"])


def suspects(stored: _rows.Stored) -> DataFrame:
    """The rows (MARKS) of the blocks whose fingerprint occurs more than once; a kept table."""
    n = partitions(stored.table.sparkSession)
    sent = keep(stored.table.select("block", "fp").mapInArrow(released(_sender(_exchange.owner_bits(n))), _SENT), "sent")
    replies = _exchange.replies(sent.where("owner >= 0").select("msg", "owner", "payload", "own"), n)
    by_msg = replies.groupBy("msg").agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("replies"))
    notes = sent.where("owner < 0").select("msg", "blocks", "sizes", "fps").join(by_msg.hint("shuffle_hash"), "msg")
    return keep(notes.mapInArrow(released(_marked), _rows.MARKS), "suspects")


def _suspect_texts(stored: _rows.Stored, marks: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(block, row, id, fp, norm) of the suspects."""
    ids, texts = (stored.schema.names.index(c) for c in (doc_id, text))

    def run(rows: pa.RecordBatch, block: int, at: list[int]) -> pa.RecordBatch:
        norm, fps = _lowered(rows, texts)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), rows.column(ids).cast(pa.int64()), pa.array(fps), pa.array(norm, pa.binary())], names=["block", "row", "id", "fp", "norm"])

    return stored.at(marks, run, "block long, row int, id long, fp long, norm binary")


def assignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    stored = _stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "text", True)
    classes = _suspect_texts(stored, suspects(stored), "doc_id", "text").groupBy("fp", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = keep(classes.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "classes")
    out = stored.narrow().join(classes, ["fp", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: the one with the largest id, whole and with all its columns."""
    stored = _stored(docs, doc_id, text, False)
    found = suspects(stored)
    order = F.struct(F.col("id").isNotNull().alias("named"), "id", "block", "row")
    best = _suspect_texts(stored, found, doc_id, text).groupBy("fp", "norm").agg(F.max(order).alias("best")).select("best.block", "best.row")
    drops = found.select("block", F.explode("rows").alias("row")).join(keep(best, "winners"), ["block", "row"], "left_anti")
    return stored.without(drops)
