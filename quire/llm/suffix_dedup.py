"""Removal of long byte strings that repeat across documents, by sorted suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id; every text is judged as it came in. Texts are UTF-8,
strings never cross documents, and all comparisons end in bytes.

Sorting every suffix of the corpus would move it dozens of times over, so only
suffixes at anchors are sorted. The anchor of a `length`-byte window is the
leftmost of its least-hashed runs of SEED bytes: equal windows have equal
anchors at equal places, so each window is decided at its anchor.
1. Documents are packed into blocks, a bucketed table that is read three times
   and never shuffled.
2. Blocks send Golomb-coded fingerprints of their anchors to owners and get
   bitmaps back; anchors of one document only are done with.
3. The suffixes at the remaining anchors, followed by what stands before them,
   are sorted for several blocks of a task at a time, equal ones are combined (the
   least id answers for all), and each owner is sent a front-coded sorted run.
4. An owner merges its runs by a loser tree that carries common-prefix lengths
   and never compares a known prefix again. In merged order, windows at offset o
   are equal where suffixes share length - o bytes and reversed predecessors
   share o; the least id of each class decides its members.
5. Blocks receive the offsets that are repeats, and mark and cut their texts.

Defined cases: null text is empty. A null id counts as larger than any other;
rows with equal or null ids never remove from each other. Texts shorter than
`length` are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange
from ._golomb import slices
from ._rows import block_ids, bucketed
from ._store import keep, partitions, released, small_batches
from ._words import blocks

LENGTH = 50
#: Bytes of an anchor.
SEED = 24
BLOCK = 4 << 20
#: Blocks of a task, and suffixes of them, that make one set of runs.
RUN_BLOCKS, RUN_ROWS = 16, 200_000
_FP_BITS = 44
_CHUNK = 1 << 18
_NO_ID = np.int64((1 << 63) - 1)


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE, _FACTORS = _constants(256, 7), _constants(8, 8)
_FINAL = np.uint64(0x9E3779B97F4A7C15)


def _zip(a) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _unzip(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


def _seed_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED bytes at each position, by doubling."""
    with np.errstate(over="ignore"):
        h = {1: _TABLE[buf]}
        for k, size in enumerate((2, 4, 8, 16)):
            half = h[size // 2]
            h[size] = half[: len(half) - size // 2] * _FACTORS[k] + half[size // 2 :]
        n = len(buf) - SEED + 1
        out = h[16][:n] * _FACTORS[5] + h[8][16 : 16 + n]
        out ^= out >> np.uint64(29)
        out *= _FINAL
        out ^= out >> np.uint64(32)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads hashes evenly again: those of anchors are minima, and most of them small."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Anchors:
    """pos: of each anchor; low, high: its first and last window; fp: its fingerprint; doc: its document."""

    def __init__(self, buf: np.ndarray, sizes: np.ndarray, length: int):
        width = length - SEED + 1
        ends = np.cumsum(sizes)
        pos, low, high, fps = [], [], [], []
        n = len(buf) - length + 1
        for at in range(0, max(n, 0), _CHUNK):
            part = buf[at : min(at + _CHUNK + length - 1, len(buf))]
            h = _seed_hashes(part)
            key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            least = _sliding_min(key, width) & np.uint64(0xFFFFFFFF)
            starts = np.arange(at, at + len(least))
            doc = np.searchsorted(ends, starts, "right")
            whole = np.flatnonzero(starts + length <= ends[doc])
            if not len(whole):
                continue
            anchor = least[whole].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1])]))
            last = np.append(new[1:], len(anchor)) - 1
            pos.append(anchor[new] + at)
            low.append(starts[whole[new]])
            high.append(starts[whole[last]])
            fps.append(_mixed(h[anchor[new]]) >> np.uint64(64 - _FP_BITS))
        none = np.zeros(0, np.int64)
        self.pos, self.low, self.high = (np.concatenate(x) if x else none for x in (pos, low, high))
        self.fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(ends, self.pos, "right")


class Block:
    def __init__(self, row: dict):
        self.ids, self.null, self.sizes = _unzip(row["ids"], "<i8"), _unzip(row["nulls"], "?"), _unzip(row["sizes"], "<i8")
        self.raw = _unzip(row["payload"])
        self.buf = np.frombuffer(self.raw, np.uint8)

    def prints(self, anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints, sorted, and those that two documents of the block have."""
        pairs = np.unique((anchors.fp << np.uint64(20)) | anchors.doc.astype(np.uint64))
        values, counts = np.unique(pairs >> np.uint64(20), return_counts=True)
        return values, counts > 1


_BLOCK = "block long, ids binary, nulls binary, sizes binary, payload binary"


def _pack(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = block_ids(TaskContext.get().partitionId(), n)
        for block in blocks(batches, ["doc_id"], size=size):
            null = np.array([x is None for x in block["doc_id"]])
            ids = np.array([_NO_ID if x is None else x for x in block["doc_id"]], np.int64)
            row = [_zip(ids), _zip(null), _zip(np.array([len(t) for t in block["text"]], np.int64)), _zip(b"".join(block["text"]))]
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *(pa.array([x], pa.binary()) for x in row)], names=["block", "ids", "nulls", "sizes", "payload"])

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}


def _send_prints(bits: int, length: int):
    schema = pa.schema([("msg", pa.int64()), ("owner", pa.int32()), ("payload", pa.binary()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            values, repeated = block.prints(Anchors(block.buf, block.sizes, length))
            yield pa.RecordBatch.from_pydict(_exchange.messages(row["block"], values, repeated, bits, _FP_BITS), schema=schema)

    return run


_RUNS = "block long, msg long, owner int, run binary"


def _contexts(block: Block, anchors: Anchors, chosen: np.ndarray, length: int) -> np.ndarray:
    """Rows of bytes: the suffix of `length` bytes at each chosen anchor, what stands before it in reverse, and its first and last offset; bytes of no window are 0."""
    before = length - SEED
    pos, low, high = anchors.pos[chosen], anchors.low[chosen], anchors.high[chosen]
    padded = np.concatenate([np.zeros(before, np.uint8), block.buf, np.zeros(length, np.uint8)])
    out = np.zeros((len(pos), length + before + 2), np.uint8)
    for at in range(0, len(pos), 65536):
        p = slice(at, at + 65536)
        columns = np.arange(length)[None, :]
        out[p, :length] = np.where(columns < (high[p] + length - pos[p])[:, None], padded[pos[p][:, None] + before + columns], 0)
        columns = np.arange(1, before + 1)[None, :]
        out[p, length:-2] = np.where(columns <= (pos[p] - low[p])[:, None], padded[pos[p][:, None] + before - columns], 0)
    out[:, -2], out[:, -1] = pos - high, pos - low
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix with the row above, and the bytes after it, of sorted byte rows."""
    width = rows.shape[1]
    prefix = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return prefix, rows[np.arange(width)[None, :] >= prefix[:, None]]


def _send_runs(bits: int, length: int):
    """Runs of several blocks at a time, named by the first (`msg`), and of every block where its suffixes stand in them."""
    schema = pa.schema([("block", pa.int64()), ("msg", pa.int64()), ("owner", pa.int32()), ("run", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # block, contexts, owners, ids, places

        def sent() -> pa.RecordBatch:
            msg = held[0][0]
            rows, owner, ids, pos = (np.concatenate([h[k] for h in held]) for k in range(1, 5))
            part = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable") if len(rows) else np.zeros(0, np.int64)
            order = order[np.argsort(owner[order], kind="stable")]
            rows, owner, ids, pos, part = rows[order], owner[order], ids[order], pos[order], part[order]
            new = np.ones(len(rows), bool)
            if len(rows):
                new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            group = np.cumsum(new) - 1
            firsts = np.flatnonzero(new)
            least = np.minimum.reduceat(ids, firsts) if len(firsts) else ids
            sent_rows, sent_owner = rows[firsts], owner[firsts].astype(np.uint64)
            out: list[tuple[int | None, int, int, bytes]] = []
            for own, a, b in slices(sent_owner, 63, 63):
                prefix, rest = front_code(sent_rows[a:b, :-2])
                out.append((None, msg, own, _packed([prefix, rest, sent_rows[a:b, -2:], least[a:b]])))
            late = ids > least[group] if len(ids) else np.zeros(0, bool)
            for k, h in enumerate(held):
                mine = part == k
                out.append((h[0], msg, -1, _packed([pos[mine].astype(np.int64), rows[mine, -2:], group[mine].astype(np.uint32), late[mine]])))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for row in _rows(batches):
            block = Block(row)
            anchors = Anchors(block.buf, block.sizes, length)
            values, _ = block.prints(anchors)
            twice = np.zeros(len(values), bool)
            for m in row["replies"] or []:
                a, b = (np.searchsorted(values, np.uint64(o << (_FP_BITS - bits))) for o in (m["owner"], m["owner"] + 1))
                twice[a:b] = _exchange.unpack(m["bitmap"], b - a)
            chosen = np.flatnonzero(twice[np.searchsorted(values, anchors.fp)]) if len(values) else np.zeros(0, np.int64)
            held.append((row["block"], _contexts(block, anchors, chosen, length), (anchors.fp[chosen] >> np.uint64(_FP_BITS - bits)).astype(np.int64), block.ids[anchors.doc[chosen]], anchors.pos[chosen]))
            if len(held) >= RUN_BLOCKS or sum(len(h[2]) for h in held) >= RUN_ROWS:
                yield sent()
                held = []
        if held:
            yield sent()

    return run


def _packed(arrays: list[np.ndarray]) -> bytes:
    parts = [_zip(x) for x in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _parts(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    cuts = 8 * len(kinds) + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<i8", len(kinds)))])
    return [_unzip(data[a:b], kind) for a, b, kind in zip(cuts, cuts[1:], kinds, strict=False)]


class _Run:
    """A front-coded run that is read forward; `prefix` is what its row shares with the last row that left the tree."""

    __slots__ = ("prefixes", "rest", "at", "cut", "row", "prefix", "width", "number")

    def __init__(self, prefixes: np.ndarray, rest: np.ndarray, width: int, number: int):
        self.prefixes, self.rest, self.width, self.number = prefixes.tolist(), rest.tobytes(), width, number
        self.at, self.cut, self.row, self.prefix = -1, 0, b"", 0
        self.step()

    def step(self) -> None:
        self.at += 1
        if self.at >= len(self.prefixes):
            self.row = None
            return
        self.prefix = p = self.prefixes[self.at]
        end = self.cut + self.width - p
        self.row = self.row[:p] + self.rest[self.cut : end]
        self.cut = end


def _play(a: _Run, b: _Run) -> tuple[_Run, _Run]:
    """(winner, loser); bytes before the shorter known prefix are never looked at."""
    if b.row is None:
        return a, b
    if a.row is None:
        return b, a
    if a.prefix != b.prefix:
        return (a, b) if a.prefix > b.prefix else (b, a)
    known = a.prefix
    if known == a.width:
        return (a, b) if a.number < b.number else (b, a)
    x, y = a.row[known:], b.row[known:]
    if x == y:
        lose = b if a.number < b.number else a
        lose.prefix = a.width
        return (a, b) if lose is b else (b, a)
    size = len(x)
    same = size - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)
    if x < y:
        b.prefix = known + same
        return a, b
    a.prefix = known + same
    return b, a


def merge(runs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser-tree merge of front-coded runs: run, place in it, and prefix shared with the row before, in merged order."""
    players = [_Run(p, r, width, k) for k, (p, r) in enumerate(runs)]
    total = sum(len(p) for p, _ in runs)
    size = 1
    while size < len(players):
        size *= 2
    empty = _Run(np.zeros(0, np.uint8), np.zeros(0, np.uint8), width, len(players))
    tree: list[_Run] = [empty] * size
    level = players + [empty] * (size - len(players))
    at = size
    while len(level) > 1:
        at //= 2
        up = []
        for k in range(0, len(level), 2):
            winner, loser = _play(level[k], level[k + 1])
            tree[at + k // 2] = loser
            up.append(winner)
        level = up
    winner = level[0]
    out_run, out_at, out_prefix = [0] * total, [0] * total, [0] * total
    for n in range(total):
        out_run[n], out_at[n], out_prefix[n] = winner.number, winner.at, winner.prefix
        node = (size + winner.number) >> 1
        winner.step()
        while node:
            other = tree[node]
            if other.row is not None:
                if winner.row is None or other.prefix > winner.prefix:
                    tree[node], winner = winner, other
                elif other.prefix == winner.prefix:
                    winner, tree[node] = _play(winner, other)
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_at, np.int64), np.array(out_prefix, np.int64)


def repeats(prefix: np.ndarray, before: np.ndarray, span: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """A bit per offset: does the window there also start in a document with a smaller id?

    prefix: shared with the row above, in merged order; before: reversed bytes before each suffix; span: first and last offset of each row.
    """
    n = len(ids)
    out = np.zeros(n, np.uint32)
    if n < 2:
        return out
    width = before.shape[1]
    order = np.argsort(np.ascontiguousarray(before).view(f"S{width}").ravel(), kind="stable")
    sorted_before = before[order]
    differ = sorted_before[1:] != sorted_before[:-1]
    shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])
    for o in range(int(span[:, 0].min()), int(span[:, 1].max()) + 1):
        here = np.flatnonzero((span[:, 0] <= o) & (span[:, 1] >= o))
        if len(here) < 2:
            continue
        suffix_class = np.cumsum(np.where(prefix < length - o, 1, 0))
        before_class = np.empty(n, np.int64)
        before_class[order] = np.cumsum(np.where(shared < o, 1, 0))
        key = suffix_class[here] * np.int64(n + 1) + before_class[here]
        by = np.argsort(key)
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = np.minimum.reduceat(ids[here[by]], np.flatnonzero(new))
        late = ids[here[by]] > least[np.cumsum(new) - 1]
        out[here[by[late]]] |= np.uint32(1 << o)
    return out


_ANSWER = "msg long, owner int, offsets binary"


def _owner(length: int):
    width = 2 * length - SEED
    schema = pa.schema([("msg", pa.int64()), ("owner", pa.int32()), ("offsets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in _exchange.by_key(batches, "owner"):
            runs = [_parts(r, ("u1", "u1", "u1", "<i8")) for r in rows["run"]]
            which, at, prefix = merge([(p, rest) for p, rest, _, _ in runs], width)
            base = np.concatenate([[0], np.cumsum([len(p) for p, *_ in runs])])
            where = base[which] + at
            span = np.concatenate([s.reshape(-1, 2) for _, _, s, _ in runs])[where]
            ids = np.concatenate([i for *_, i in runs])[where]
            before = np.zeros((len(where), width - length), np.uint8)
            decoded = np.concatenate([_unfold(p, rest, width)[:, length:] for p, rest, _, _ in runs])
            before[:] = decoded[where]
            flags = np.zeros(len(where), np.uint32)
            flags[where] = repeats(prefix, before, span, ids, length)
            found = [_zip(flags[a:b]) for a, b in zip(base, base[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["msg"], pa.int64()), pa.array([owner] * len(found), pa.int32()), pa.array(found, pa.binary())], schema=schema)

    return run


def _unfold(prefix: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """The byte rows of a front-coded run."""
    n = len(prefix)
    given = np.arange(width)[None, :] >= prefix[:, None]
    rows = np.zeros((n, width), np.uint8)
    rows[given] = rest
    last = np.where(given, np.arange(n)[:, None], 0)
    np.maximum.accumulate(last, axis=0, out=last)
    return rows[last, np.arange(width)[None, :]]


FULL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>, kept binary"


def _runs(starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, document) of the maximal runs that strings of `length` bytes at `starts` cover, documents apart."""
    doc = np.searchsorted(ends, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > starts[:-1] + length) | (doc[1:] != doc[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(starts)) - 1 if len(starts) else np.zeros(0, np.int64)
    return starts[new], starts[last] + length, doc[new]


def _cut(length: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            starts = np.zeros(len(block.buf) + 1, bool)
            if row["places"]:
                pos, span, group, local = _parts(row["places"], ("<i8", "u1", "<u4", "?"))
                span = span.reshape(-1, 2).astype(np.int64)
                answers = sorted(row["answers"] or [], key=lambda x: x["owner"])
                flags = np.concatenate([np.zeros(0, np.uint32), *(_unzip(a["offsets"], "<u4") for a in answers)])
                every = ((np.int64(2) << span[:, 1]) - (np.int64(1) << span[:, 0])).astype(np.uint32)
                flags = np.where(local, every, flags[group]) if len(group) else flags[:0]
                for o in range(length - SEED + 1):
                    starts[pos[(flags >> np.uint32(o)) & np.uint32(1) > 0] - o] = True
            ends = np.cumsum(block.sizes)
            firsts = ends - block.sizes
            begin, stop, doc = _runs(np.flatnonzero(starts), ends, length)
            removed, n_spans = np.bincount(doc, stop - begin, len(ends)).astype(np.int64), np.bincount(doc, minlength=len(ends))
            at = np.searchsorted(doc, np.arange(len(ends) + 1))
            view = memoryview(block.raw)
            kept, shas, where = [], [], []
            for k, (a, b) in enumerate(zip(firsts.tolist(), ends.tolist(), strict=True)):
                own = slice(at[k], at[k + 1])
                text = b"".join(view[x:y] for x, y in zip([a, *stop[own].tolist()], [*begin[own].tolist(), b], strict=True)) if removed[k] else view[a:b]
                shas.append(hashlib.sha256(text).hexdigest())
                if whole:
                    kept.append(bytes(text))
                    where.append([{"start": x - a, "length": y - x} for x, y in zip(begin[own].tolist(), stop[own].tolist(), strict=True)])
            columns = [pa.array(block.ids, mask=block.null), pa.array(block.sizes), pa.array(removed), pa.array(n_spans), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if whole:
                columns += [pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, whole: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `whole` also spans and the kept bytes."""
    if not SEED <= length < SEED + 32:
        raise ValueError(f"length must be from {SEED} to {SEED + 31}")
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    bits = _exchange.owner_bits(n)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = bucketed(rows.mapInArrow(released(_pack(BLOCK, n)), _BLOCK), n)
    sent = table.mapInArrow(released(_send_prints(bits, length)), _exchange.SENT)
    bitmaps = _exchange.replies(sent, n).groupBy(F.col("msg").alias("block")).agg(F.collect_list(F.struct("owner", "bitmap")).alias("replies"))
    runs = keep(table.join(bitmaps.hint("shuffle_hash"), "block", "left").mapInArrow(released(_send_runs(bits, length)), _RUNS), "runs")
    owned = runs.where("owner >= 0").drop("block").repartition(n, "owner").sortWithinPartitions("owner")
    answers = owned.mapInArrow(released(_owner(length)), _ANSWER)
    places = runs.where("owner < 0").select("block", F.col("run").alias("places"))
    told = runs.where("owner < 0").select("block", "msg").join(answers, "msg")  # an answer goes to each block of its message
    by_block = told.groupBy("block").agg(F.collect_list(F.struct("owner", "offsets")).alias("answers"))
    replies = places.join(by_block.hint("shuffle_hash"), "block", "left")
    joined = table.join(replies.hint("shuffle_hash"), "block", "left")
    schema = FULL if whole else FULL.split(", spans")[0]
    return joined.mapInArrow(released(_cut(length, whole)), schema)
