"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where over half of a text's shingle hashes have it
(XXH64, seed 42, of space-joined runs of words; A-Z lower-cased, repeats count).
Distinct fingerprints within `radius` bits are linked:
1. The 64 bits are cut into `parts`; two fingerprints within the radius agree on
   at least parts - radius of them, so each goes to a bucket for every choice
   of that many parts. The number of parts follows the number of fingerprints,
   which keeps buckets small; no pair is lost at any setting. A bucket of more
   than TILE values is dealt over several tasks, by pairs of its tiles.
2. The buckets of a task stand one after another as 64 vertical bit planes. For
   every distance d, all fingerprints are compared at once with those d places
   on: planes and shifted planes are added into carry-save counters, 64 pairs to
   a word, and a word is abandoned once all its pairs exceed the radius. Pairs
   that are connected already are left out.
3. A bucket yields the links of a spanning forest, never all pairs; components
   come from star contractions over the links.

`similar_deduplicated` is the same operator for texts of a Jaccard similarity of
0.8 or more in five-word shingles. Fingerprints of such texts differ in up to
some 20 of 64 bits, where no choice of parts is selective; so bands of least
shingle hashes name the buckets, the bit-sliced comparison decides in them, and
exact similarity verifies what it leaves (`_similar`).

Defined cases: null or wordless texts have fingerprint zero and are linked like
any other. Texts with fewer words than a shingle hash their whole word sequence.
Repeated ids are one row each. Null ids never name a component unless all its
ids are null. `deduplicated` leaves one row of each component, also where ids
repeat or are null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _graph, _rows, _similar
from ._bits import planes, within
from ._store import keep, partitions, released, small_batches

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Values of a bucket that one task compares with as many others.
TILE = 4096
#: Values that stand in one set of bit planes.
_LANES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text, in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)], np.uint64)
        counts += _bit_counts(h)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long) per row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(_fingerprints), "doc_id long, fp long")


def plan(n: int, radius: int = RADIUS) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of the parts and the choices of parts that must agree, for n fingerprints."""
    parts = radius + 1
    while parts < 2 * radius and (64 * (parts - radius)) // parts < n.bit_length() + 1:
        parts += 1
    edges = [64 * k // parts for k in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)], list(combinations(range(parts), parts - radius))


def forest(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect, within each bucket, all values that chains of links within the radius connect.

    ends: for every value, the end of its bucket.
    """
    n = len(values)
    vertical = np.concatenate([planes(values), np.zeros((64, 2), np.uint64)], axis=1)
    root = np.arange(n)
    links: list[tuple[int, int]] = []
    lanes, d = np.flatnonzero(ends - np.arange(n) > 1), 1
    while len(lanes):
        apart = lanes[root[lanes] != root[lanes + d]]
        near = within(vertical, apart, d, radius) if len(apart) else apart
        for i in near.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, i + d))
        if len(near):
            while (root != (up := root[root])).any():
                root = up
            least = np.minimum.reduceat(root, (starts := np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))))
            whole = np.maximum.reduceat(root, starts) == least  # one component: nothing is left to compare
            lanes = lanes[~np.repeat(whole, np.diff(np.append(starts, n)))[lanes]]
        d += 1
        lanes = lanes[lanes + d < ends[lanes]]
    return links


def _bucket_links(radius: int):
    """Links of the buckets of a partition that is sorted by its columns before fp; whole buckets are gathered up to _LANES values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held, n = [], 0

        def compared(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            cut = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, len(values))
            ends = np.repeat(cut, np.diff(cut, prepend=0))
            at = np.array(forest(values.view(np.uint64), ends, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(values[at[:, 0]]), pa.array(values[at[:, 1]])], schema=schema)

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(c).to_numpy() for c in ("choice", "bucket", "low", "high", "fp")]).astype(np.int64))
                n += batch.num_rows
            if n >= _LANES:
                every = np.concatenate(held, axis=1)
                last = np.flatnonzero((every[:4, 1:] != every[:4, :-1]).any(axis=0))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield compared(every[:4, :whole], every[4, :whole])
                held, n = [every[:, whole:]], every.shape[1] - whole
        if n:
            every = np.concatenate(held, axis=1)
            yield compared(every[:4], every[4])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of a kept table (fp)."""
    spark = distinct.sparkSession
    masks, choices = plan(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(masks[i] for i in c) for c in choices)]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for k, m in enumerate(signed)])
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.bucket", "fp")
    dense = keep(dealt.groupBy("choice", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("choice", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "dense")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))
    tiles = tiles.otherwise(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("low"), F.greatest(t, own).alias("high"))))
    every = dealt.join(dense, ["choice", "bucket"], "left").select("choice", "bucket", "fp", F.explode(tiles).alias("t")).select("choice", "bucket", "t.low", "t.high", "fp")
    by = ["choice", "bucket", "low", "high"]
    return every.repartition(partitions(spark), *by).sortWithinPartitions(*by, "fp").mapInArrow(released(_bucket_links(radius)), "a long, b long")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of every fingerprint of a kept table (doc_id, fp): the smallest doc_id reachable; a kept table."""
    first = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return named(first, links(first.select("fp"), radius))


def named(first: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component, component_id) from the least id of each fp and links (a, b); a kept table."""
    comps = _graph.components(linked, "a", "b")
    every = keep(first.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    ids = keep(every.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    return keep(every.join(ids, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    prints = keep(fingerprints(docs, doc_id, text), "prints")
    return prints.join(grouped(prints, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest id, of several the first stored."""
    column = docs.columns.index(text)

    def prints(part: pa.RecordBatch) -> dict[str, list]:
        texts = part.column(column).cast(pa.binary()).to_pylist()
        return {"id": part.column("id"), "fp": np.array([fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64)}

    stored = _rows.store(docs, {"id": F.col(doc_id).cast("long")}, prints, {"id": "long", "fp": "long"})
    rows = stored.narrow()
    return stored.without(copies(rows, grouped(rows.select(F.col("id").alias("doc_id"), "fp"), radius)))


def similar_deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = _similar.SIMILARITY) -> DataFrame:
    """docs with one row of each group of texts linked by the similarity: that of the smallest id, of several the first stored."""
    column = docs.columns.index(text)
    stored = _rows.store(docs, {"id": F.col(doc_id).cast("long")}, _similar.prints(column), {"id": "long", **_similar.FIELDS})
    rows = stored.narrow()
    first = keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    return stored.without(copies(rows, named(first, _similar.links(stored, column, similarity))))


def copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(block, row) of all rows (block, row, id, fp) but one of each component (fp, component): that of the smallest id, of several the first."""
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "block", "row")
    firsts = keep(rows.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    best = firsts.join(groups, "fp").groupBy("component").agg(F.min("first").alias("best"))
    return rows.select("block", "row").join(keep(best.select("best.block", "best.row"), "winners"), ["block", "row"], "left_anti")
