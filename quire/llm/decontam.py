"""Benchmark decontamination by CGK walks and bit-sampling LSH over item-sized windows of words.

Texts and items are sequences of normalised words (ASCII letters and digits, A-Z
in lower case, and all that is not ASCII). A document is contaminated by an item if some stretch of it is within
(1 - similarity) * words of the item in edit distance over words.
1. Item-sized windows: a stretch within e edits of an item of n words shares
   at least n - q + 1 - e q of its q-grams, within e of one diagonal; each
   diagonal that reaches that count starts a window. This loses no stretch.
2. CGK embedding: window and item walk through random copies of their words, a
   word being repeated or left by a random bit of step and word, which maps edit
   distance to Hamming distance. Walks go from the front and from the back, as
   alignment may be lost at either end, over the whole item, and REPETITIONS
   times with fresh bits.
3. Bit-sampling LSH: SAMPLES words of a walk are a key, TABLES times a walk; a
   pair of document and item is a candidate if a window meets the item in any
   table. The numbers are chosen by measured recall at the limit (README).
4. The windows of candidate pairs are decided by the exact edit distance of the
   item to the best stretch of their neighbourhood.

Words are hashed alike everywhere, so results do not depend on how items or
texts fall into blocks. Items go to the executors in blocks of bounded size, one
scan of the documents for each block; documents are never shuffled.

Defined cases: null or empty texts are clean. Items without words match nothing;
items of fewer words than edits allow are matched exactly. Repeated items and
rows count each. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows
from ._store import keep, released, small_batches
from ._words import Words

SIMILARITY = 0.8
#: Fresh walks from either end, keys of a walk, and sampled words of a key.
REPETITIONS, TABLES, SAMPLES = 4, 64, 2
#: Steps that walks of a batch of windows take together, at most.
WALKED = 1 << 20
#: Words of items that go to the executors at once.
ITEM_WORDS = 1_000_000
#: Cells of a distance table that are computed at once.
CELLS = 1 << 20
_OTHER = 0

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    """Lower-cases A-Z and turns ASCII that is no letter or digit into spaces. Bytes from 128 on stay as they are: accented capitals and typographic quotes or dashes in a word count as edits."""
    return text.translate(_FOLD)


def edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def seed_plan(n: int, e: int) -> tuple[int, int]:
    """(q, least shared q-grams): the longest q up to 3 that leaves at least one."""
    for q in (3, 2, 1):
        if n - q + 1 - e * q >= 1:
            return q, n - q + 1 - e * q
    return 1, 1


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the stretch of text that is nearest to the item."""
    column = np.arange(len(item) + 1)
    steps = np.arange(len(item) + 1)
    best = (int(column[-1]), 0)
    for j, word in enumerate(text.tolist(), 1):
        step = np.minimum(column[:-1] + (item != word), column[1:] + 1)
        column = np.concatenate([[0], step])
        column = np.minimum.accumulate(column - steps) + steps
        if column[-1] < best[0]:
            best = (int(column[-1]), j)
    return best


def best_stretches(items: np.ndarray, sizes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """best_stretch's distance by row; items are padded beyond their size, texts with words of no item."""
    steps, rows = np.arange(items.shape[1] + 1, dtype=np.int32), np.arange(len(items))
    column = np.tile(steps, (len(items), 1))
    best = sizes.astype(np.int32)
    for word in texts.T:
        step = np.minimum(column[:, :-1] + (items != word[:, None]), column[:, 1:] + 1)
        column[:, 0], column[:, 1:] = 0, step
        column = np.minimum.accumulate(column - steps, axis=1) + steps
        best = np.minimum(best, column[rows, sizes])
    return best


def _spread(shape: tuple[int, ...], seed: int) -> np.ndarray:
    """Odd 64-bit factors, by a rule of their place alone."""
    x = np.arange(int(np.prod(shape)), dtype=np.uint64) + np.uint64(seed << 32)
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).reshape(shape) | np.uint64(1)


def walks(words: np.ndarray, sizes: np.ndarray, repetition: int) -> np.ndarray:
    """CGK walks over rows of word hashes: at every step the word at hand is copied, and left by a random bit of step and word; 0 behind the last."""
    steps = 2 * words.shape[1]
    factors = _spread((steps,), 2 * repetition + 1)
    rows, at = np.arange(len(words)), np.zeros(len(words), np.int64)
    out = np.zeros((len(words), steps), np.uint64)
    for t in range(steps):
        word = np.where(at < sizes, words[rows, np.minimum(at, words.shape[1] - 1)], np.uint64(0))
        out[:, t] = word
        at += ((word * factors[t]) >> np.uint64(63)).astype(np.int64)
    return out


def keys(walked: np.ndarray, sizes: np.ndarray, repetition: int) -> np.ndarray:
    """TABLES keys of each walk, of SAMPLES words of its first 2 * size steps; odd where all are words, 0 where one lies behind the end."""
    share = (_spread((TABLES, SAMPLES), 2 * repetition) >> np.uint64(32)).astype(np.float64) / 2**32
    at = (share[None, :, :] * (2 * sizes)[:, None, None]).astype(np.int64)
    picked = walked[np.arange(len(walked))[:, None, None], at]
    h = np.zeros(picked.shape[:2], np.uint64)
    for k in range(SAMPLES):
        h = (h ^ picked[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.where((picked != 0).all(axis=2), h | np.uint64(1), np.uint64(0))


class Index:
    """Items as word numbers and hashes, their q-gram seeds and LSH keys. Words of no item are number 0."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float):
        words = Words([folded(t) for _, t in items])
        self.vocabulary = words.distinct()
        self.ids = [i for i, _ in items]
        bounds = words.doc_first
        self.items = [words.inverse[a:b] + 1 for a, b in zip(bounds, bounds[1:], strict=False)]
        self.hashes = [words.keys[x - 1] | np.uint64(1) for x in self.items]
        order = np.argsort(words.keys)
        self.keys, self.numbers = words.keys[order], order + 1
        self.edits = np.array([edits(len(x), similarity) for x in self.items], np.int64)
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.need = np.ones(len(items), np.int64)
        self._keys: dict[int, np.ndarray] = {}
        by_q: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, x in enumerate(self.items):
            if len(x):
                q, self.need[k] = seed_plan(len(x), int(self.edits[k]))
                by_q[q] += [(self.gram(x[a : a + q]), k, a) for a in range(len(x) - q + 1)]
        self.seeds = {}
        for q, found in by_q.items():
            grams = np.array([g for g, _, _ in found], np.uint64)
            order = np.argsort(grams, kind="stable")
            self.seeds[q] = grams[order], np.array([k for _, k, _ in found])[order], np.array([a for _, _, a in found])[order]

    @staticmethod
    def gram(x: np.ndarray) -> int:
        h = 0
        for w in x.tolist():
            h = (h * 0x9E3779B97F4A7C15 + w) & (1 << 64) - 1
        return h

    @staticmethod
    def grams(numbers: np.ndarray, q: int) -> np.ndarray:
        n = len(numbers) - q + 1
        h = np.zeros(max(n, 0), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(q):
                h = h * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + n].astype(np.uint64)
        return h

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first word of the window) that reach the seed count; then the block's word numbers and documents."""
        at = np.minimum(np.searchsorted(self.keys, words.keys), max(len(self.keys) - 1, 0))
        forms = words.distinct_at(np.flatnonzero(self.keys[at] == words.keys)) if len(self.keys) else []
        number_of = np.zeros(len(words.keys), np.int64)
        for k, form in forms:
            number = int(self.numbers[at[k]])
            if self.vocabulary[number - 1] == form:
                number_of[k] = number
        numbers, doc = number_of[words.inverse], words.doc_of()
        found = []
        for q, (grams, items, places) in self.seeds.items():
            known = numbers > 0
            n = max(len(numbers) - q + 1, 0)
            whole = np.ones(n, bool)
            for k in range(q):
                whole &= known[k : k + n]
            if n:
                whole &= doc[:n] == doc[q - 1 :]
            pos = np.flatnonzero(whole)
            h = self.grams(numbers, q)[pos]
            lo, hi = np.searchsorted(grams, h), np.searchsorted(grams, h, "right")
            hit = hi - lo
            rep = np.repeat(np.arange(len(pos)), hit)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(hit) - hit, hit) + lo[rep]
            item = items[inner]
            found.append(np.stack([doc[pos[rep]], item, pos[rep] - places[inner]]))
        cells = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        # enough seeds of one item within its allowed edits of a diagonal
        cells = cells[:, np.lexsort((cells[2], cells[1], cells[0]))]
        group = np.zeros(cells.shape[1], np.int64)
        if cells.shape[1]:
            group[1:] = np.cumsum((cells[0, 1:] != cells[0, :-1]) | (cells[1, 1:] != cells[1, :-1]))
        span = np.int64(1 << 40)
        flat = group * span + cells[2] - (cells[2].min() if cells.shape[1] else 0)
        e = self.edits[cells[1]]
        count = np.searchsorted(flat, flat + e, "right") - np.searchsorted(flat, flat - e)
        good = np.flatnonzero(count >= self.need[cells[1]])
        good = good[np.concatenate([[True], np.diff(flat[good]) > 0])] if len(good) else good
        return cells[0, good], cells[1, good], cells[2, good], numbers, doc

    def item_keys(self, k: int) -> np.ndarray:
        """The keys of an item, by repetition and direction."""
        if k not in self._keys:
            x, size = self.hashes[k][None, :], self.sizes[k : k + 1]
            self._keys[k] = np.concatenate([keys(walks(w, size, r), size, r) for r in range(REPETITIONS) for w in (x, x[:, ::-1])])
        return self._keys[k]

    def met(self, words: Words, docs: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows belong to a (document, item) pair that meets in an LSH table."""
        pair = np.concatenate([[0], np.cumsum((docs[1:] != docs[:-1]) | (items[1:] != items[:-1]))])
        found = np.zeros(int(pair[-1]) + 1, bool)
        hashes, sizes = words.keys[words.inverse] | np.uint64(1), self.sizes[items]
        order = np.argsort(sizes, kind="stable")
        for r in range(REPETITIONS):
            for back in (0, 1):
                left = order[~found[pair[order]]]
                at = 0
                while at < len(left):
                    rows = left[at : at + max(1, WALKED // (2 * int(sizes[left[at]])))]
                    rows = rows[: max(1, WALKED // (2 * int(sizes[rows[-1]])))]
                    at += len(rows)
                    size = sizes[rows]
                    place = np.arange(int(size.max()))[None, :]
                    place = starts[rows][:, None] + (size[:, None] - 1 - place if back else place)
                    inside = (place >= np.maximum(words.doc_first[docs[rows]], starts[rows])[:, None]) & (place < np.minimum(words.doc_first[docs[rows] + 1], starts[rows] + size)[:, None])
                    window = np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(2))
                    own = keys(walks(window, size, r), size, r)
                    stated = np.stack([self.item_keys(k)[2 * r + back] for k in items[rows].tolist()])
                    found[pair[rows[((own == stated) & (own != 0)).any(axis=1)]]] = True
        return found[pair]

    def matches(self, texts: list[bytes]) -> dict[tuple[int, int], int]:
        """(document, item) -> distance, for all that meet in a table and are within the item's edits."""
        words = Words([folded(t) for t in texts])
        docs, items, starts, numbers, _ = self.windows(words)
        best: dict[tuple[int, int], int] = {}
        if len(docs):
            met = self.met(words, docs, items, starts)
            docs, items, starts = docs[met], items[met], starts[met]
        if not len(docs):
            return best
        # windows of a document and item that start within an item's length of one another are one stretch to search
        part = (starts - starts.min()) // self.sizes[items]
        first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (items[1:] != items[:-1]) | (part[1:] != part[:-1])]))
        last = np.append(first[1:], len(docs)) - 1
        docs, items = docs[first], items[first]
        low = np.maximum(words.doc_first[docs], starts[first] - self.edits[items])
        high = np.minimum(words.doc_first[docs + 1], starts[last] + self.sizes[items] + self.edits[items])
        order = np.argsort(self.sizes[items], kind="stable")
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, CELLS // (4 * int(self.sizes[items[order[at]]])))]
            width = int(self.sizes[items[rows[-1]]])
            rows = rows[: max(1, CELLS // (4 * width))]
            at += len(rows)
            sizes = self.sizes[items[rows]]
            stated = np.full((len(rows), int(sizes.max())), -1, np.int64)
            for r, k in enumerate(items[rows].tolist()):
                stated[r, : self.sizes[k]] = self.items[k]
            cells = low[rows][:, None] + np.arange(int((high - low)[rows].max()))[None, :]
            text = np.where(cells < high[rows][:, None], numbers[np.minimum(cells, len(numbers) - 1)], _OTHER)
            found = best_stretches(stated, sizes, text)
            for k in np.flatnonzero(found <= self.edits[items[rows]]).tolist():
                pair = int(docs[rows[k]]), int(items[rows[k]])
                best[pair] = min(int(found[k]), best.get(pair, int(found[k])))
        return best


def _item_blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about `words` words, read row by row."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        text = (row.text or "").encode()
        size = len(folded(text).split())
        if held and n + size > words:
            yield held
            held, n = [], 0
        held.append((row.item_id, text))
        n += size
    yield held


def _found(index: Index, part: pa.RecordBatch, column: int) -> dict[str, list]:
    """Per row, the number of items, and of the nearest (ties: the smallest id) its id, distance and words."""
    count, best = [0] * part.num_rows, [None] * part.num_rows
    texts = [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
    for (d, k), distance in index.matches(texts).items():
        count[d] += 1
        size = int(index.sizes[k])
        mark = (distance / size, index.ids[k] is None, index.ids[k] or 0, distance, size)
        best[d] = mark if best[d] is None else min(best[d], mark)
    return {"items": count, "item": [b and (None if b[1] else b[2]) for b in best], "distance": [b and b[3] for b in best], "words": [b and b[4] for b in best]}


def _matched(rows: DataFrame, items: list[tuple[int, bytes]], similarity: float) -> DataFrame:
    """(row, doc_id, text) to (row, doc_id, items, item, distance, words) for one block of items."""
    index = Index(items, similarity)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("items", pa.int64()), ("item", pa.int64()), ("distance", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _rows.parts(batch):
                yield pa.RecordBatch.from_pydict({"row": part.column(0), "doc_id": part.column(1)} | _found(index, part, 2), schema=schema)

    return rows.mapInArrow(released(run), "row long, doc_id long, items long, item long, distance int, words int")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, item_words: int = ITEM_WORDS) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, and of the nearest item (ties: the smallest id) item_id, distance (words) and similarity."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stated = _item_blocks(benchmark, item_words)
    first, second = next(stated), next(stated, None)
    if second is None:
        out = _matched(rows, first, similarity)
    else:  # blocks of items meet by row, not by id, so that repeated ids stay apart; each block is done with before the next is read
        rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        every = None
        for items in itertools.chain([first, second], stated):
            part = keep(_matched(rows, items, similarity), "matched")
            every = part if every is None else every.unionByName(part)
        order = F.when(F.col("items") > 0, F.struct(F.col("distance") / F.col("words"), "item"))
        out = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("items").alias("items"), F.min_by("item", order).alias("item"), F.min_by("distance", order).alias("distance"), F.min_by("words", order).alias("words"))
    return out.select(
        "doc_id", (F.col("items") > 0).alias("contaminated"), F.col("items").alias("n_items"), F.col("item").alias("item_id"), "distance", (1 - F.col("distance") / F.col("words")).alias("similarity"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, item_words: int = ITEM_WORDS) -> DataFrame:
    """docs without the contaminated rows, with all their columns."""
    small_batches(docs.sparkSession)
    column = docs.columns.index(text)
    stated = _item_blocks(benchmark, item_words)
    first, second = next(stated), next(stated, None)
    if second is None:
        index = Index(first, similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _rows.parts(batch):
                    yield part.filter(pa.array([n == 0 for n in _found(index, part, column)["items"]], pa.bool_()))

        return docs.mapInArrow(released(run), docs.schema)
    stored = _rows.store(docs, {}, lambda part: {}, {})
    drops = None
    for items in itertools.chain([first, second], stated):
        part = keep(_hits(stored, items, similarity, column), "hits")
        drops = part if drops is None else drops.unionByName(part)
    return stored.without(drops.distinct())


def _hits(stored: _rows.Stored, items: list[tuple[int, bytes]], similarity: float, column: int) -> DataFrame:
    """(block, row) of the stored rows that one block of items contaminates."""
    index = Index(items, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                rows = np.flatnonzero(_found(index, _rows.unpacked(blob.as_buffer()), column)["items"]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(rows)], names=["block", "row"])

    return stored.table.select("block", "rows").mapInArrow(released(run), "block long, row int")
