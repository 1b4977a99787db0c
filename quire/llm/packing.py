"""Hierarchical multi-length packing of documents into training sequences.

A document's ids, then its end, are cut into whole windows of the longest tier
and a rest, which is routed to the shortest tier that holds it. Tiers are packed
from the longest down: a window takes the longest rest of its tier, its gap is
filled with the longest pieces of shorter tiers that fit, and what still remains
is closed with a cut of the shortest piece at hand. Windows are so exactly as
long as their tier, a power of two, and need no padding. The last window of a
block is cut at powers of two instead.

Blocks of documents are packed where they lie: no text or id is shuffled, a task holds
one block at a time, and every block is a pure function of its rows. The pieces
are written once; from the numbers of windows of each task and length follows
where its windows stand among all of that length, and so they are dealt into step
groups of equally many tokens: of each length, only the last group can be short.

Defined cases: null and empty texts are their end alone. Rows that repeat an id
are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bpe
from ._store import keep, released, small_batches
from ._words import blocks

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP_TOKENS = 1 << 15
END = 1

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long"
RESULT = f"{_PIECE}, step_group long"
#: The pieces of a task: its number, and that of the window among the task's windows of its length.
_TASK = f"{_PIECE}, part long, window long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, as lists of (document, start, length); every sequence is as long as a power of two."""
    longest = tiers[-1]
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), by length

    def route(piece: tuple[int, int, int]) -> None:
        insort(pools[next(t for t in tiers if t >= piece[0])], piece)

    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            yield [(doc, start, longest)]
        if n % longest:
            route((n % longest, doc, n - n % longest))
    for tier in reversed(tiers):
        while pools[tier]:
            size, doc, start = pools[tier].pop()
            window, gap = [(doc, start, size)], tier - size
            while gap:
                pool = next((p for t in reversed(tiers) if t <= tier and (p := pools[t]) and p[0][0] <= gap), None)
                if pool:
                    size, doc, start = pool.pop(bisect_right(pool, (gap, len(lengths), 0)) - 1)
                    window.append((doc, start, size))
                    gap -= size
                    continue
                pool = next((pools[t] for t in tiers if pools[t]), None)
                if pool is None:
                    break
                size, doc, start = pool.pop(0)
                window.append((doc, start, gap))
                route((size - gap, doc, start + gap))
                gap = 0
            if not gap:
                yield window
            else:
                yield from _cut(window, tier - gap)


def _cut(window: list[tuple[int, int, int]], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Cuts a window at powers of two, the largest first."""
    pieces = list(reversed(window))
    while size:
        room = part = 1 << (size.bit_length() - 1)
        out = []
        while room:
            doc, start, n = pieces.pop()
            if n > room:
                pieces.append((doc, start + room, n - room))
                n = room
            out.append((doc, start, n))
            room -= n
        yield out
        size -= part


def _packer(path: str, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _bpe.tokens(path)
        part = TaskContext.get().partitionId()
        sequence = part << 33
        windows = Counter()  # of each length, so far
        schema = pa.schema([(c.split()[0], pa.int64()) for c in _TASK.split(", ")])
        for block in blocks(batches, ["doc_id"]):
            ids, first = tokens.documents(block["text"])
            lengths = (np.diff(first) + 1).tolist()
            raw = [memoryview(ids[a:b].tobytes() + END.to_bytes(4, "little")) for a, b in zip(first, first[1:], strict=False)]
            rows: list[tuple] = []
            for pieces in pack(lengths, tiers):
                size = sum(p[2] for p in pieces)
                offset = 0
                for doc, start, n in pieces:
                    rows.append((block["doc_id"][doc], start, n, zlib.crc32(raw[doc][4 * start : 4 * (start + n)]), lengths[doc], sequence, offset, size, part, windows[size]))
                    offset += n
                sequence += 1
                windows[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def grouped(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """RESULT of a kept table of pieces (_TASK): windows of a length are numbered over all tasks, and each run of step_tokens is a group."""
    counts = pieces.groupBy("tier", "part").agg((F.max("window") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    firsts = counts.select("tier", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    group = F.floor((F.col("first") + F.col("window")) / F.greatest(F.lit(1), F.lit(step_tokens) / F.col("tier")))
    return pieces.join(firsts, ["tier", "part"]).select(*(c.split()[0] for c in _PIECE.split(", ")), (group * 64 + F.round(F.log2("tier"))).cast("long").alias("step_group"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Per piece: RESULT. tiers: powers of two, ascending."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return grouped(keep(rows.mapInArrow(released(_packer(tokenizer or default_path(), tuple(tiers))), _TASK), "pieces"), step_tokens)
