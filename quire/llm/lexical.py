"""Ranked lexical search over an index of impact-ordered postings.

1. The index: documents in blocks of some MB, one table row each, with the terms
   of the block, the documents and frequencies of each term, and the lengths. It
   is written once, and no text is read or shuffled after that.
2. Statistics of the queries' terms are sums over the index.
3. Score at a time: in a block, the postings of each term are grouped by their exact
   impact. The groups of a query's terms are taken in descending order, whatever
   their term, and added to the scores so far. What can still come is at most the
   sum of the next impact of each term. Once this bound proves that no other
   document can pass the k-th, the scores of the few that can are completed from the
   postings in order of documents.
4. A task carries the k-th score of each query from block to block, so later blocks
   stop sooner, and all tasks begin with the k-th score of a first few blocks, which
   bounds the final one from below. The best of the tasks are merged by rank.

Queries are a stated set, read in blocks of a bounded number of terms; a block
reads the index once. Scores are 64-bit integers as the contract states them.

Defined cases: null texts have no terms. A query without terms, or whose terms no
document has, gives no rows. Rows that repeat an id are ranked each, as are
queries that repeat one; a null id comes last among equal scores. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import keep, released, small_batches
from ._words import Words, blocks

K = 50
#: Distinct terms of a block of queries, and the queries in it.
QUERY_TERMS, QUERIES = 100_000, 5_000
#: Blocks of the index from which the first bounds come.
FIRST_BLOCKS = 24
#: Bytes of text in a block of the index, and postings that are added between two looks at the bounds.
INDEX_BYTES, STRIDE = 8 << 20, 4096
_INDEX = "block long, ids binary, named binary, lengths binary, terms binary, starts binary, docs binary, freqs binary, n_docs long, n_terms long"
_HIT = "query int, doc_id long, score long"
_TERM = np.full(256, 32, np.uint8)
_TERM[48:58], _TERM[97:123], _TERM[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_TERM[65:91] = np.arange(97, 123)
_TERM_BYTES = _TERM.tobytes()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and bytes beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for block in blocks(batches, ["doc_id"], size=INDEX_BYTES):
        words = Words([t.translate(_TERM_BYTES) for t in block["text"]], lower=False)
        doc, form, count = words.pairs()
        order = np.argsort(form, kind="stable")  # by term, then document
        starts = np.searchsorted(form[order], np.arange(len(words.first) + 1))
        lengths = np.diff(words.doc_first)
        ids = block["doc_id"]
        row = [
            at,
            np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
            np.array([i is not None for i in ids], bool).tobytes(),
            lengths.astype(np.int64).tobytes(),
            b" ".join(words.distinct()),
            starts.astype(np.int32).tobytes(),
            doc[order].astype(np.int32).tobytes(),
            count[order].astype(np.int32).tobytes(),
            int(np.count_nonzero(lengths)),
            int(lengths.sum()),
        ]
        at += 1
        types = [pa.int64()] + [pa.binary()] * 7 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _INDEX.split(", ")])


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, a kept table."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return keep(rows.mapInArrow(released(_indexer), _INDEX), "postings")


def query_blocks(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, the distinct terms of each) of queries, in blocks; they are read one partition at a time."""
    ids, held, distinct = [], [], set()
    for row in queries.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        own = list(dict.fromkeys(terms((row.t or "").encode())))
        if ids and (len(ids) >= QUERIES or len(distinct) + len(own) > QUERY_TERMS):
            yield ids, held
            ids, held, distinct = [], [], set()
        ids.append(row.i)
        held.append(own)
        distinct.update(own)
    if ids:
        yield ids, held


def _counter(wanted: frozenset[bytes]):
    """(term, df) of the wanted terms, summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            for named, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                df = np.diff(np.frombuffer(starts, np.int32))
                for k, term in enumerate(named.split()):
                    if term in wanted:
                        sums[term] = sums.get(term, 0) + int(df[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], names=["term", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Postings:
    """The postings of a block for the terms of a block of queries, in both orders."""

    def __init__(self, row: dict, numbers: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int):
        lengths = np.frombuffer(row["lengths"], np.int64)
        starts, docs, freqs = (np.frombuffer(row[c], np.int32) for c in ("starts", "docs", "freqs"))
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        place = 100 - 50 + (50 * lengths * n_docs) // max(n_terms, 1)
        found = [(numbers[t], k) for k, t in enumerate(row["terms"].split()) if t in numbers]
        #: Of each term that is here: its postings by document, and by impact in groups (impact, first, size).
        self.by_doc: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        ordered, at = [], 0
        for number, k in found:
            if weights[number] <= 0:
                continue
            doc, tf = docs[starts[k] : starts[k + 1]], freqs[starts[k] : starts[k + 1]].astype(np.int64)
            impact = weights[number] * ((1_000_000_000 * tf) // (1000 * tf + 20 * place[doc]))
            order = np.argsort(-impact, kind="stable")
            falling = impact[order]
            first = np.flatnonzero(np.concatenate([[True], falling[1:] != falling[:-1]]))
            self.by_doc[number] = doc, impact
            self.groups[number] = falling[first], at + first, np.diff(np.append(first, len(doc)))
            ordered.append(doc[order])
            at += len(doc)
        self.ordered = np.concatenate(ordered) if ordered else np.zeros(0, np.int32)

    def best(self, query: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, scores): all that are among the k best of the block and reach least, and perhaps more; every score is whole."""
        own = [t for t in query if t in self.groups]
        least = max(least, 1)
        heads = np.array([self.groups[t][0][0] for t in own], np.int64)
        if heads.sum() < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        impacts, firsts, sizes = (np.concatenate([self.groups[t][c] for t in own]) for c in range(3))
        sources = np.repeat(np.arange(len(own)), [len(self.groups[t][0]) for t in own])
        order = np.argsort(-impacts, kind="stable")
        cut = np.searchsorted(np.cumsum(sizes[order]), np.arange(STRIDE, int(sizes.sum()) + STRIDE, STRIDE)) + 1
        offsets = np.concatenate([[0], np.cumsum([len(self.groups[t][0]) for t in own])])
        done = np.zeros(len(own), np.int64)  # groups of each term that are added
        scores = np.zeros(len(self.ids), np.int64)
        last, bound, rest = 0, least, 0
        for end in np.unique(np.minimum(cut, len(order))):
            part = order[last:end]
            last = end
            docs = self.ordered[_ranges(firsts[part], sizes[part])]
            scores += np.bincount(docs, np.repeat(impacts[part], sizes[part]), len(scores)).astype(np.int64)  # below 2^53
            done += np.bincount(sources[part], minlength=len(own))
            left = offsets[:-1] + done < offsets[1:]
            rest = int(impacts[(offsets[:-1] + done)[left]].sum())
            if len(scores) > k:
                bound = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if rest < bound:
                break
        able = np.flatnonzero(scores + rest >= bound)
        if not rest:
            return able, scores[able]
        whole = np.zeros(len(able), np.int64)
        for t in own:
            doc, impact = self.by_doc[t]
            where = np.minimum(np.searchsorted(doc, able), len(doc) - 1)
            whole += np.where(doc[where] == able, impact[where], 0)
        keep_ = whole >= least
        return able[keep_], whole[keep_]


class _Best:
    """The k best documents so far: by score, then id, null last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ids, self.named = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        scores, ids, named = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.named, named])
        order = np.lexsort((ids, ~named, -scores))[: self.k]
        self.scores, self.ids, self.named = scores[order], ids[order], named[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def _searcher(queries: list[list[int]], numbers: dict[bytes, int], weights: list[int], n_docs: int, n_terms: int, k: int, least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Best(k, b) for b in least]
        weighed = np.array(weights, np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                postings = Postings(row, numbers, weighed, n_docs, n_terms)
                for query, best in zip(queries, held, strict=True):
                    places, scores = postings.best(query, k, best.least)
                    if len(places):
                        best.add(scores, postings.ids[places], postings.named[places])
        for q, best in enumerate(held):
            if len(best.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), q, np.int32)), pa.array(best.ids, mask=~best.named), pa.array(best.scores)], names=["query", "doc_id", "score"])

    return run


_POSTINGS = ("ids", "named", "lengths", "terms", "starts", "docs", "freqs")
#: Ways into which the hits of a query go before their last merge.
WAYS = 32


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, score, rank) of the k best of each query; first in each of several parts, so that no task merges what all tasks found."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parted = hits.withColumn("way", F.pmod(F.xxhash64("doc_id"), F.lit(WAYS)))
    few = parted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "way").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "way")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the index with the highest scores above 0 for every query."""
    spark: SparkSession = index.sparkSession
    small_batches(spark)
    kind = queries.schema[item_id].dataType
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = int(totals.n or 0), int(totals.l or 0)
    first = [r.block for r in index.select("block").orderBy("block").limit(FIRST_BLOCKS).collect()]
    out = None
    for ids, asked in query_blocks(queries, item_id, text):
        wanted = frozenset(t for q in asked for t in q)
        found = index.select("terms", "starts").mapInArrow(released(_counter(wanted)), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # QUERY_TERMS at most
        numbers = {bytes(r.term): at for at, r in enumerate(found)}
        weights = [weight(n_docs, r.df) for r in found]
        stated = [sorted(numbers[t] for t in q if t in numbers) for q in asked]
        given = (stated, numbers, weights, n_docs, n_terms, k)
        some = index.where(F.col("block").isin(first)).select(*_POSTINGS).mapInArrow(released(_searcher(*given, [0] * len(ids))), _HIT)
        least = [0] * len(ids)
        for r in _merged(some, k).where(F.col("rank") == k).collect():  # one row a query
            least[r.query] = r.score
        hits = _merged(index.select(*_POSTINGS).mapInArrow(released(_searcher(*given, least)), _HIT), k)
        names = spark.createDataFrame([(at, i) for at, i in enumerate(ids)], f"query int, item_id {kind.simpleString()}")
        ranked = hits.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # QUERIES at most
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
