"""Links between texts by the Jaccard similarity of five-word shingles, for the SimHash operator.

Texts are lower-cased and split at white space; a text is the set of its
shingles (64-bit hashes). Texts of `similarity` or more are linked:
1. MinHash bands gather texts: `ROWS` minima of a set under hash functions make a
   key, BANDS times. A pair at the limit of 0.8 is missed with probability
   (1 - 0.8^ROWS)^BANDS = 7e-5, a closer one less often.
2. In a bucket, texts stand in order of size, and their SimHash fingerprints are
   compared bit-sliced (`_bits`). Fingerprints of texts at the limit differ in 15 %
   of their bits, 10 of 64 with a deviation of 3, and over RADIUS with probability
   2e-4. Sizes too different for the limit are left out, which loses no pair.
3. A pair within the radius whose minima agree so seldom that the limit is
   SLACK deviations away is left out (probability 3e-5 at the limit).
4. What is left is verified in its bucket by the exact Jaccard similarity of the
   texts, which are sent to each bucket once; pairs are never rows. A bucket
   yields links that connect its components, so texts that are connected already
   are not compared again.
Buckets go in two rounds, a quarter and then, of the others, those that hold more than
one component yet. Buckets are cut into runs of bounded length; while one is
longer, one text of each component stands for it in another round, and what is
left then is dealt by pairs of runs. A large group of copies so neither costs its
square nor lies in one task.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _graph, _rows
from ._bits import planes, within
from ._store import keep, partitions, released

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Bits of 64 by which fingerprints of similar texts may differ.
RADIUS = 20
#: Deviations that the share of equal minima may be below the limit.
SLACK = 4.0
#: Sets of a bucket that one task compares.
RUN = 4096
FIELDS = {"fp": "long", "n": "long", "sim": "long", "sig": "binary", "bands": "array<long>"}
_STEP = 2048
#: Shingles of the texts that one comparison holds, if a bucket has no more, and of the sets that it remembers.
_HELD, _REMEMBERED = 1 << 21, 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_FLIPS, _FACTORS, _BAND_SEEDS = (_RNG.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, BANDS))
_FACTORS |= np.uint64(1)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, in UTF-8, ascending."""
    words = text.decode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    span = min(shingle, len(words))
    n = len(words) - span + 1
    h = np.zeros(n, np.uint64)
    for k in range(span):
        h = _mixed(h, hashes[k : k + n])
    return np.unique(h)


def minima(h: np.ndarray) -> np.ndarray:
    """The least values of a set that is not empty under BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), _STEP):
        np.minimum(least, ((h[at : at + _STEP, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key per band."""
    key = _BAND_SEEDS
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key, row)
    return key


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if set in over half of its shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h), bitorder="little").tobytes(), "little")


def _digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 42) if len(h) else 0


def prints(column: int):
    def run(part: pa.RecordBatch) -> dict[str, list]:
        sets = [shingles(t or b"") for t in part.column(column).cast(pa.binary()).to_pylist()]
        least = [minima(h) if len(h) else None for h in sets]
        keys = [np.zeros(0, np.int64) if x is None else band_keys(x).view(np.int64) for x in least]
        fp, sim = (np.array([f(h) for h in sets], np.uint64).view(np.int64) for f in (_digest, fingerprint))
        sig = [b"" if x is None else (x & np.uint64(255)).astype(np.uint8).tobytes() for x in least]  # minima are small, their low bytes are not
        return {"id": part.column("id"), "fp": fp, "n": np.array([len(h) for h in sets], np.int64), "sim": sim, "sig": pa.array(sig, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))}

    return run


def _texts(column: int):
    """(fp, text) of marked rows, the text compressed: it is smaller than its set."""

    def run(rows: pa.RecordBatch, block: int, at: list[int]) -> pa.RecordBatch:
        texts = [t or b"" for t in rows.column(column).cast(pa.binary()).to_pylist()]
        fp = np.array([_digest(shingles(t)) for t in texts], np.uint64).view(np.int64)
        packer = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary())], names=["fp", "text"])

    return run


class Sets:
    """The shingle sets of compressed texts, of which the last ones are remembered."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.sets, self.size, self.unpack = texts, OrderedDict(), 0, zstandard.ZstdDecompressor().decompress

    def of(self, k: int) -> np.ndarray:
        if k in self.sets:
            self.sets.move_to_end(k)
            return self.sets[k]
        found = self.sets[k] = shingles(self.unpack(self.texts[k]))
        self.size += len(found)
        while self.size > _REMEMBERED and len(self.sets) > 2:
            self.size -= len(self.sets.popitem(last=False)[1])
        return found

    def similar(self, i: int, j: int, similarity: float) -> bool:
        x, y = self.of(i), self.of(j)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return common + 1e-9 >= similarity * (len(x) + len(y) - common)


def bucket_links(keys: np.ndarray, size: np.ndarray, sim: np.ndarray, component: np.ndarray, sig: np.ndarray, texts: list[bytes], similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(i, j) of rows of one key that connect, with the given components, all that links by the similarity connect.

    Rows stand in order of their key (columns of `keys`) and size.
    """
    n = len(sim)
    cut = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, n)
    ends = np.repeat(cut, np.diff(cut, prepend=0))
    starts = np.append(0, cut[:-1])
    vertical = np.concatenate([planes(sim.view(np.uint64)), np.zeros((64, 2), np.uint64)], axis=1)
    least = similarity - SLACK * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5
    code = np.unique(component, return_inverse=True)[1]
    root, sets, links = np.arange(int(code.max(initial=-1)) + 1), Sets(texts), []
    lanes, d = np.flatnonzero(ends - np.arange(n) > 1), 1
    while len(lanes):
        lanes = lanes[size[lanes] + 1e-9 >= similarity * size[lanes + d]]  # what is too long at one distance is so at all longer ones
        apart = lanes[root[code[lanes]] != root[code[lanes + d]]]
        near = within(vertical, apart, d, radius) if len(apart) else apart
        near = near[(sig[near] == sig[near + d]).mean(axis=1) >= least] if len(near) else near
        joined = False
        for i in near.tolist():
            a, b = code[i], code[i + d]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b and sets.similar(i, i + d, similarity):
                root[max(a, b)] = min(a, b)
                links.append((i, i + d))
                joined = True
        if joined:
            while (root != (up := root[root])).any():
                root = up
            own = root[code]
            whole = np.maximum.reduceat(own, starts) == np.minimum.reduceat(own, starts)  # one component: nothing is left to compare
            lanes = lanes[~np.repeat(whole, np.diff(np.append(starts, n)))[lanes]]
        d += 1
        lanes = lanes[lanes + d < ends[lanes]]
    return links


_COLUMNS = ("band", "low", "high", "n", "fp", "sim", "component")


def _linker(similarity: float):
    """bucket_links over a partition in order of band, low, high and size; whole buckets are gathered up to _HELD shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes], list[bytes]]] = []

        def joined() -> tuple[np.ndarray, list[bytes], list[bytes]]:
            return np.concatenate([h[0] for h in held], axis=1), [s for h in held for s in h[1]], [t for h in held for t in h[2]]

        def compared(x: np.ndarray, sigs: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
            at = np.array(bucket_links(x[:3], x[3], np.ascontiguousarray(x[5]), x[6], sig, texts, similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[4][at[:, 0]]), pa.array(x[4][at[:, 1]])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((np.stack([batch.column(c).to_numpy() for c in _COLUMNS]).astype(np.int64), batch.column("sig").to_pylist(), batch.column("text").to_pylist()))
            if sum(int(h[0][3].sum()) for h in held) >= _HELD:
                x, sigs, texts = joined()
                last = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield compared(x[:, :whole], sigs[:whole], texts[:whole])
                held = [(x[:, whole:], sigs[whole:], texts[whole:])]
        if held:
            yield compared(*joined())

    return run


def _linked(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within the buckets of rows (band, low, high, n, fp, sim, component); texts: (fp, sig, text)."""
    by = ["band", "low", "high"]
    whole = rows.select(*_COLUMNS).join(texts, "fp")
    dealt = whole.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "n", "fp")
    return dealt.mapInArrow(released(_linker(similarity)), "a long, b long")


def links(stored: _rows.Stored, column: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect the digests of the sets of stored documents (side: id and FIELDS), whose texts stand in `column`."""
    rows = stored.narrow()
    dealt = rows.dropDuplicates(["fp"]).select("fp", "n", "sim", F.explode("bands").alias("band"))
    counts = keep(dealt.groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "bands")
    crowd = keep(dealt.join(counts, "band").select("band", "many", "n", "fp", "sim"), "crowd")
    first = F.min(F.struct("block", "row", "sig"))
    met = keep(rows.groupBy("fp").agg(first.alias("x")).join(crowd.select("fp").distinct(), "fp", "left_semi").select("fp", "x.block", "x.row", "x.sig"), "met")
    bodies = stored.at(_rows.by_block(met), _texts(column), "fp long, text binary")
    texts = keep(bodies.join(met.select("fp", "sig"), "fp"), "texts")
    longest = counts.agg(F.max("many")).first()[0] or 0
    found, held = [], crowd.withColumn("component", F.col("fp"))

    def joined(rows: DataFrame, last: bool = False) -> None:
        """Adds the links of a round, and names the components anew."""
        nonlocal held
        found.append(keep(_linked(rows, texts, similarity), "links"))
        if not last and not found[-1].isEmpty():
            named = _graph.components(_all(found), "a", "b").select(F.col("node").alias("fp"), "component")
            held = keep(crowd.join(named, "fp", "left").select("band", "many", "n", "fp", "sim", F.coalesce("component", "fp").alias("component")), "held")

    def mixed() -> DataFrame:
        """The buckets with several components, and how many runs they make."""
        spread = held.groupBy("band").agg(F.count(F.lit(1)).alias("rest"), F.min("component").alias("x"), F.max("component").alias("y"))
        return keep(spread.where("x <> y").select("band", F.ceil(F.col("rest") / RUN).cast("int").alias("tiles")), "mixed")

    def in_runs(rows: DataFrame, turn: int = 0) -> DataFrame:
        return rows.withColumns({"low": F.pmod(F.xxhash64(F.lit(turn), "fp"), F.ceil(F.col("many") / F.lit(RUN ** (turn + 1)))), "high": F.lit(0)})

    quarter = F.pmod(F.xxhash64("band"), F.lit(4)) == 0
    joined(in_runs(held.where(quarter)))
    joined(in_runs(held.where(~quarter).join(mixed().select("band"), "band")), last=longest <= RUN)
    turn, rest = 0, longest
    while rest > RUN:
        turn, rest = turn + 1, rest // RUN + 1
        stands = held.groupBy("band", "component").agg(F.min(F.struct("n", "fp", "sim")).alias("s"), F.max("many").alias("many"))
        joined(in_runs(stands.select("band", "many", "s.n", "s.fp", "s.sim", "component"), turn))
    if longest > RUN:
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("low"), F.greatest(t, own).alias("high")))
        open_rows = held.join(mixed().where("tiles > 1"), "band").withColumn("t", F.explode(tiles))
        joined(open_rows.select("band", "t.low", "t.high", "n", "fp", "sim", "component"), last=True)
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
