"""Filter interaction audit: what each filter removes in every order of application.

1. A fingerprint-routed RDD: texts go by their XXH64 to the owner of the value.
   Before the shuffle a task keeps one chain entry for equal texts, so a group
   of copies of any size costs one row per task and flush. The owner reads its
   records sorted by fingerprint and holds one collision chain at a time: full text
   and minimum id of each text of that fingerprint. Every id that is not the minimum is
   emitted as a copy, the minimum at the end of the chain.
2. What comes out is narrow: id, part, a bit mask of the filters that the
   document fails, and how many rows are alike. Labels are joined by id.
3. combineByKey merges, per part, a vector of counts over the masks: documents,
   those labelled good and those labelled toxic. From 2^k counts follow all k!
   orders, without another look at the documents. Which parts there are is read
   from their column alone.

Defined cases: null text counts as empty, a null part as the empty string. A text
is a copy if a row with a smaller id has the same bytes; rows that repeat an id
and a text are no copies of each other; a null id is larger than any other. Of
labels that repeat an id, one with the value is enough; a null id has no label.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, permutations
from operator import itemgetter
from typing import NamedTuple

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import partitions, released

#: Bytes of distinct texts that a task holds before it sends them.
HELD_BYTES = 32 << 20
SEED = 42
MOST_FILTERS = 7
_CAPITALS = bytes(range(65, 91))
_TRAILS = bytes(range(0x80, 0xC0))
_MARKED = re.compile(rb"[#$%&*|]")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Measures(NamedTuple):
    """What filters look at. Words are maximal runs without ASCII white space; chars are code points."""

    words: int
    distinct: int
    capitals: int
    chars: int
    marked: bool


def measured(text: bytes) -> Measures:
    words = text.split()
    return Measures(len(words), len(set(words)), len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _TRAILS)), _MARKED.search(text) is not None)


#: What fails a document, by the filter's letter. Copies have a letter of their own: COPIES.
RULES: dict[str, Callable[[Measures], bool]] = {
    "A": lambda m: m.words < 100,
    "B": lambda m: 100 * m.distinct < 80 * m.words,
    "C": lambda m: 100 * m.capitals > 10 * m.chars,
    "D": lambda m: m.marked,
}
COPIES = "E"


def _before(a: int | None, b: int | None) -> bool:
    return a is not None and (b is None or a < b)


class _Chain:
    """Texts with their mask, minimum id, and the rows of that id by part; others leave as copies."""

    def __init__(self, copy_bit: int):
        self.links: dict[bytes, list] = {}
        self.copy_bit = copy_bit

    def add(self, text: bytes, mask: int | None, doc_id: int | None, rows: dict[str, int]) -> tuple | None:
        """The copies that this shows: (id, mask, rows)."""
        link = self.links.get(text)
        if link is None:
            self.links[text] = [mask, doc_id, Counter(rows)]
        elif doc_id == link[1]:
            link[2].update(rows)
        elif _before(doc_id, link[1]):
            out = (link[1], link[0] | self.copy_bit, dict(link[2]))
            link[1:] = [doc_id, Counter(rows)]
            return out
        else:
            return doc_id, link[0] | self.copy_bit, rows
        return None


def _sender(rules: tuple[Callable, ...]):
    """(key, (text, mask, id, rows)) of rows (id, text, part); known copies have no text and go anywhere."""
    copy_bit = 1 << len(rules)

    def send(rows: Iterator) -> Iterator[tuple]:
        chain, held = _Chain(copy_bit), 0

        def flush() -> Iterator[tuple]:
            for text, (mask, doc_id, counts) in chain.links.items():
                yield xxhash.xxh64_intdigest(text, SEED), (text, mask, doc_id, dict(counts))

        for doc_id, text, part in rows:
            text = bytes(text)
            mask = None
            if text not in chain.links:
                seen = measured(text)
                mask = sum(1 << k for k, fails in enumerate(rules) if fails(seen))
                held += len(text) + 256
            if copy := chain.add(text, mask, doc_id, {part: 1}):
                yield xxhash.xxh64_intdigest(str(copy[0]), SEED), (None, copy[1], copy[0], copy[2])
            if held >= HELD_BYTES:
                yield from flush()
                chain, held = _Chain(copy_bit), 0
        yield from flush()

    return send


def _owner(copy_bit: int):
    """(id, part, mask, n) of records sorted by key; one chain is held at a time."""

    def resolve(records: Iterator[tuple]) -> Iterator[tuple]:
        for _, same in groupby(records, itemgetter(0)):
            chain = _Chain(copy_bit)
            for _, (text, mask, doc_id, rows) in same:
                copy = (doc_id, mask, rows) if text is None else chain.add(text, mask, doc_id, rows)
                if copy:
                    yield from ((copy[0], part, copy[1], n) for part, n in copy[2].items())
            for mask, doc_id, rows in chain.links.values():
                yield from ((doc_id, part, mask, n) for part, n in rows.items())

    return resolve


def _own_key(key: int) -> int:
    return key


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", rules: dict[str, Callable[[Measures], bool]] | None = None) -> DataFrame:
    """(doc_id, part, mask, n): n documents of an id and part fail the filters of mask; bit k is the k-th rule, the last bit that of copies."""
    spark = docs.sparkSession
    tests = tuple((RULES if rules is None else rules).values())
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p")).rdd
    routed = rows.mapPartitions(released(_sender(tests))).repartitionAndSortWithinPartitions(partitions(spark), _own_key)
    return spark.createDataFrame(routed.mapPartitions(released(_owner(1 << len(tests)))), "doc_id long, part string, mask int, n long", verifySchema=False)


def _added(vector: list[int], row: tuple) -> list[int]:
    mask, *counts = row
    for k, n in enumerate(counts):
        vector[3 * mask + k] += n
    return vector


def _merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _orders(letters: str):
    """The rows of a part from its vector of counts."""
    bits = {c: 1 << k for k, c in enumerate(letters)}

    def told(row: tuple) -> Iterator[tuple]:
        part, vector = row
        counts = [vector[3 * m : 3 * m + 3] for m in range(1 << len(letters))]

        def total(test: Callable[[int], bool], k: int = 0) -> int:
            return sum(c[k] for m, c in enumerate(counts) if test(m))

        steps = {}  # by the filters before and the filter: kept, removed, redundant, unique, good, toxic
        for order in permutations(letters):
            before = 0
            for c in order:
                bit, gone = bits[c], before
                if (gone, c) not in steps:
                    here = [total(lambda m, bit=bit, gone=gone: m & bit and not m & gone, k) for k in range(3)]
                    steps[gone, c] = (total(lambda m, bit=bit, gone=gone: not m & (gone | bit)), here[0], total(lambda m, bit=bit, gone=gone: m & bit and m & gone), counts[bit][0], here[1], here[2])
                before |= bit
        shapley = Counter()
        for order in permutations(letters):
            for k, c in enumerate(order):
                shapley[c] += steps[sum(bits[x] for x in order[:k]), c][1]
        for order in permutations(letters):
            for k, c in enumerate(order):
                yield part, "".join(order), k + 1, *steps[sum(bits[x] for x in order[:k]), c], shapley[c]

    return told


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", rules: dict[str, Callable[[Measures], bool]] | None = None) -> DataFrame:
    """RESULT: one row per part, order of the filters and step. labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    letters = "".join(RULES if rules is None else rules) + COPIES
    if len(set(letters)) < len(letters) or len(letters) > MOST_FILTERS:
        raise ValueError(f"filters have one letter each, not {COPIES}, and are {MOST_FILTERS} at most")
    flags = labels.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")))
    joined = failures(docs, doc_id, text, part, rules).join(flags, "doc_id", "left")
    counted = joined.select("part", "mask", "n", *(F.coalesce(F.col("n") * F.col(c), F.lit(0)) for c in ("quality", "toxic"))).rdd.map(lambda r: (r[0], tuple(r[1:])))
    size = 3 << len(letters)
    vectors = counted.combineByKey(lambda row: _added([0] * size, row), _added, _merged, partitions(spark))
    parts = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).distinct()
    return parts.join(spark.createDataFrame(vectors.flatMap(_orders(letters)), RESULT, verifySchema=False), "part")
