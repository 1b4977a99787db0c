"""Language-model scores by the marginal likelihood of a subword lattice.

Tokens are the words of the lower-cased (A-Z) text and one end. The model is a
mixture over the languages g of the training rows (the most frequent ones, and
the rest as one), each backing off to all rows and these to the lattice:

    P(text) = sum over g and a of docs_g / docs * U_g,a(words) * P_g(end) / |a|
    P_g(t)  = (max(c_g - D_g, 0) + D_g * V_g * P(t)) / N_g
    P(t)    = (max(c - D, 0) + D * V * L(t)) / N

U_g,a is an urn: the i-th word is t with probability (a P_g(t) + k) / (a + i - 1),
k being its occurrences among the words before. So a word that a text has used
is likelier to come again, whether it was seen in training or only by the
lattice; a takes the values of URNS, without end for independent words.

c is the token's count in the training documents, N all their tokens, V
the distinct ones, D the absolute discount n1 / (n1 + 2 n2), and L the lattice
likelihood: the sum, over all segmentations into pieces of an existing
vocabulary, of the product of piece weights, by a forward recursion in log
space. Weights start from the vocabulary's own scores and are re-estimated by
expectation-maximisation over all distinct training words. A row's language is
read for training rows only; a text is scored from its tokens alone.

1. Documents are interned block by block, and a task's blocks are merged some at a
   time: a merged block holds its documents as (word, count) pairs, and each
   distinct word once with its training counts. It is stored bucketed and not
   moved again. How many owners (ranges of word hashes) there are follows from
   what all blocks hold, so that an owner gets about OWNED bytes.
2. Each merged block sends an owner its words; owners sum counts over all blocks.
3. Passes over the owners' words re-estimate the weights; what reaches the
   driver is one number per vocabulary piece.
4. Owners answer each block with counts and lattice scores; blocks sum them.

Defined cases: null text is empty and has the end as its only token. A null id
is a training row, a null language is among the rest. Without training documents
every base score is 0 and the score is the lattice's alone. Rows that repeat an
id are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _lattice
from ._exchange import by_key
from ._golomb import slices
from ._rows import block_ids, bucketed
from ._store import held_out, keep, partitions, released, small_batches
from ._words import Words, blocks

#: Bytes of text that are interned at once, and of words and documents in a merged block.
BLOCK, MERGED = 4 << 20, 12 << 20
#: Bytes of words that an owner gets, about.
OWNED = 4 << 20
ROUNDS = 2
#: Share of the lattice's weight that is left for the end of a document.
END = 1e-4
#: Languages with counts of their own.
LANGUAGES = 7
#: Weights of the model in the urns besides that of independent words.
URNS = (100.0, 1000.0, 10000.0)
#: Natural logs below a text's best language at which its urns are left out of the sum.
FAR = 40.0


def _zip(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _unzip(data: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


_BLOCKS = "block long, size long, words binary, counts binary, docs array<binary>"


def _intern(groups: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = block_ids(TaskContext.get().partitionId(), n)
        schema = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("docs", pa.list_(pa.binary()))])
        forms: list[bytes] = []
        counts: list[np.ndarray] = []
        docs: list[list[bytes]] = []

        def merged() -> pa.RecordBatch:
            words = Words(forms, lower=False)
            sums = np.stack([np.bincount(words.inverse, c, len(words.first)) for c in np.concatenate(counts, axis=1)]).astype(np.uint32)
            own = [words.inverse[a:b].astype(np.uint32) for a, b in zip(words.doc_first, words.doc_first[1:], strict=False)]
            whole = [_joined([*parts, _zip(places)]) for parts, places in zip(docs, own, strict=True)]
            every = b"\n".join(words.distinct())
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([next(numbers)], [len(every)], [_zip(every)], [_zip(sums)], [whole]), schema, strict=True)], schema=schema)

        for block in blocks(batches, ["doc_id", "held", "group"], size=BLOCK):
            words = Words(block["text"])
            doc, form, count = words.pairs()
            held = np.array(block["held"], bool)
            group = np.where(held, groups, np.array(block["group"], np.int64))
            cell = group[doc] * len(words.first) + form
            counts.append(np.bincount(cell, count, (groups + 1) * len(words.first)).astype(np.uint32).reshape(groups + 1, -1)[:groups])
            forms.append(b"\n".join(words.distinct()))
            first = np.searchsorted(doc, np.arange(len(held) + 1)).astype(np.uint32)
            step = np.diff(form, prepend=0)
            step[first[:-1][np.diff(first) > 0]] = form[first[:-1][np.diff(first) > 0]]
            ids = np.array([x if x is not None else 0 for x in block["doc_id"]], np.int64)
            null = np.array([x is None for x in block["doc_id"]])
            docs.append([_zip(x) for x in (ids, null, held, first, step.astype(np.uint32), count.astype(np.uint32))])
            if sum(map(len, forms)) + sum(len(p) for parts in docs for p in parts) >= MERGED:
                yield merged()
                forms, counts, docs = [], [], []
        if docs:
            yield merged()

    return run


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


_SENT = "block long, owner int, words binary, counts binary"


def _send(owner_bits: int, groups: int):
    """A merged block's words by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for number, given, counted in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                words = Words([_unzip(given)], lower=False)  # distinct, in order of their keys
                forms, counts = words.distinct(), _unzip(counted, "<u4").reshape(groups, -1)
                out = [(number, owner, _zip(b"\n".join(forms[a:b])), _zip(counts[:, a:b])) for owner, a, b in slices(words.keys, owner_bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


_OWNERS = "owner int, words binary, counts binary, blocks array<long>, places array<binary>, stats array<long>"


def _statistics(counts: np.ndarray) -> list[int]:
    """Tokens, distinct tokens, and those with counts of one and of two."""
    return [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]


def _gather(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("owner", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])
        for owner, rows in by_key(batches, "owner"):
            words = Words([_unzip(w) for w in rows["words"]], lower=False)
            sent = np.concatenate([_unzip(c, "<u4").reshape(groups, -1) for c in rows["counts"]], axis=1)
            counts = np.stack([np.bincount(words.inverse, c, len(words.first)) for c in sent]).astype(np.int64)
            places = [_zip(words.inverse[a:b].astype(np.uint32)) for a, b in zip(words.doc_first, words.doc_first[1:], strict=False)]
            stats = [x for c in (counts.sum(axis=0), *counts) for x in _statistics(c)]
            row = (owner, _zip(b"\n".join(words.distinct())), _zip(counts), rows["block"], places, stats)
            yield pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, row, strict=True)}, schema=schema)

    return run


def _expect(vocabulary: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = _lattice.pieces(vocabulary), np.zeros(len(logp))
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                forms = _unzip(w).split(b"\n")
                counts = _unzip(c, "<i8").reshape(-1, len(forms)).sum(axis=0)
                total += pieces.expectations([forms[k] for k in np.flatnonzero(counts > 0).tolist()], logp)
        used = np.flatnonzero(total > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

    return run


def train(owners: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-weights of the pieces, summing to 1 - END."""
    prior = _lattice.pieces(vocabulary).prior
    logp = prior + math.log1p(-END)
    for _ in range(rounds):
        sums = owners.select("words", "counts").mapInArrow(released(_expect(vocabulary, logp)), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.exp(prior)  # the vocabulary's own scores, with the weight of one word
        for row in sums.toLocalIterator():
            uses[row.piece] += row.uses
        logp = np.log(uses / uses.sum()) + math.log1p(-END)
    return logp


_ANSWERS = "block long, owner int, counts binary, likelihoods binary"


def _answer(vocabulary: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _lattice.pieces(vocabulary)
        schema = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("counts", pa.binary()), ("likelihoods", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("owner", "words", "counts", "blocks", "places")}
                forms = _unzip(row["words"]).split(b"\n")
                counts = _unzip(row["counts"], "<i8").reshape(-1, len(forms)).astype(np.uint32)
                scores = pieces.totals(forms, logp).astype(np.float32)
                for block, place in zip(row["blocks"], row["places"], strict=True):
                    at = _unzip(place, "<u4")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([row["owner"]], pa.int32()), pa.array([_zip(counts[:, at])]), pa.array([_zip(scores[at])])], schema=schema
                    )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _discounted(counts: np.ndarray, below: np.ndarray, stats: list[int]) -> np.ndarray:
    """Log-probabilities from counts with absolute discount; below: logs of the distribution that the discount goes to."""
    total, distinct, once, twice = stats
    if not total:
        return below
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(counts - discount, 0) / total), below + math.log(discount * distinct / total))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series behind a shift of eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def urn_gains(weight: float, logp: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """What the urn adds to each document's log-probability of independent words; a cell is a distinct word of a document with its count."""
    cells, words = np.bincount(doc, minlength=n_docs), np.bincount(doc, count, n_docs)
    more = np.flatnonzero(count > 1)
    p, c = weight * np.exp(logp[more]), count[more].astype(float)
    again = log_gamma(p + c) - log_gamma(p + 1) - (c - 1) * logp[more]
    one = np.array([weight])
    return cells * math.log(weight) + np.bincount(doc[more], again, n_docs) + log_gamma(one) - log_gamma(weight + words)


def _score(stats: list[list[int]], ends: list[int]):
    """stats: of all training tokens, then of each group's, ends included; ends: training documents of each group."""
    total, distinct = stats[0][:2]
    live = [g for g in range(len(ends)) if ends[g]]

    def logs(counts: np.ndarray, log_l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = counts.sum(axis=0)
        base = np.log10((every + 0.5) / (total + 0.5 * (distinct + 1)))
        below = _discounted(every, log_l.astype(np.float64), stats[0])
        return base, np.stack([_discounted(counts[g], below, stats[1 + g]) for g in live] or [below])

    end_base, end_score = logs(np.array(ends)[:, None], np.array([math.log(END)]))
    share = np.log([ends[g] / sum(ends) for g in live] or [1.0])[:, None]

    def scored(block: bytes, base: np.ndarray, score: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        """RESULT of one block; base, score and seen: by word of the merged block."""
        cuts = 56 + np.concatenate([[0], np.cumsum(np.frombuffer(block, "<i8", 7))])
        ids, null, held, first, step, count, places = (_unzip(block[a:b], kind) for a, b, kind in zip(cuts, cuts[1:], ("<i8", "?", "?", "<u4", "<u4", "<u4", "<u4"), strict=False))
        n = len(ids)
        # words of a document are stored by their steps, which start anew at each document
        form = places.astype(np.int64)[_undo(step, first)] if len(step) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n), np.diff(first.astype(np.int64)))
        count = count.astype(np.int64)
        add = lambda x: np.bincount(doc, x, n)
        words, known = add(count), add(count * seen[form])
        whole = np.stack([add(count * x[form]) for x in score]) + end_score + share
        near, kinds = whole > whole.max(axis=0) - FAR, [whole]
        for weight in URNS:
            kinds.append(np.full_like(whole, -np.inf))
            for g in range(len(score)):
                at = np.flatnonzero(near[g][doc])
                gain = urn_gains(weight, score[g][form[at]], count[at], doc[at], n)
                kinds[-1][g] = np.where(near[g], whole[g] + gain, -np.inf)
        whole = np.concatenate(kinds) - math.log(1 + len(URNS))
        top = whole.max(axis=0)
        columns = [
            pa.array(ids, mask=null), pa.array(held), pa.array(words.astype(np.int64) + 1), pa.array(known.astype(np.int64) + (sum(ends) > 0)), pa.array(np.full(n, total, np.int64)),
            pa.array(add(count * base[form]) + end_base[0]), pa.array((top + np.log(np.exp(whole - top).sum(axis=0))) / math.log(10)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, answers in zip(batch.column("docs").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                answers = sorted(answers or [], key=lambda x: x["owner"])
                counts = np.concatenate([np.zeros((len(ends), 0), np.int64), *(_unzip(a["counts"], "<u4").reshape(len(ends), -1) for a in answers)], axis=1).astype(np.int64)
                base, score = logs(counts, np.concatenate([np.zeros(0, np.float32), *(_unzip(a["likelihoods"], "<f4") for a in answers)]))
                known = counts.sum(axis=0) > 0
                for block in docs:
                    yield scored(block, base, score, known)

    return run


def _undo(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    if not len(total):
        return total
    sizes = np.diff(first.astype(np.int64))
    before = np.where(first[:-1] > 0, total[np.maximum(first[:-1].astype(np.int64) - 1, 0)], 0)
    return total - np.repeat(before, sizes)


def scores(docs: DataFrame, remainder: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: RESULT. Rows whose crc32(doc_id as text) mod 5 is `remainder` are held out of all counts."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = vocabulary or _lattice.default_path()
    n = partitions(spark)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        held_out(F.col(doc_id), remainder).alias("held"),
        (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("lang"),
    )
    train_rows = rows.where(~F.col("held"))
    named = [r.lang for r in train_rows.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    groups = len(named) + 1
    group = F.lit(groups - 1)
    for k, name in enumerate(named):
        group = F.when(F.col("lang") == name, k).otherwise(group)
    rows = rows.withColumn("group", F.coalesce(group, F.lit(groups - 1))).drop("lang")
    table = bucketed(rows.mapInArrow(released(_intern(groups, n)), _BLOCKS), n)
    size = table.agg(F.sum("size")).first()[0] or 0
    sent = table.select("block", "words", "counts").mapInArrow(released(_send(max(2, n.bit_length(), (size // OWNED).bit_length()), groups)), _SENT)
    owned = sent.repartition(n, "owner").sortWithinPartitions("owner")
    owners = keep(owned.mapInArrow(released(_gather(groups)), _OWNERS), "lm-owners")
    sums = owners.agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(4 * (groups + 1)))).first()
    stats = [[int(x or 0) for x in sums[4 * k : 4 * k + 4]] for k in range(groups + 1)]
    found = {r.group: r["count"] for r in rows.where(~F.col("held")).groupBy("group").count().collect()}
    ends = [found.get(k, 0) for k in range(groups)]
    for own, count in zip(stats, [sum(ends), *ends], strict=True):  # the end is a token too
        own[0], own[1] = own[0] + count, own[1] + (count > 0)
    logp = train(owners.select("words", "counts"), vocabulary, rounds)
    answers = owners.drop("stats").mapInArrow(released(_answer(vocabulary, logp)), _ANSWERS)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "counts", "likelihoods")).alias("answers"))
    joined = table.select("block", "docs").join(by_block.hint("shuffle_hash"), "block", "left").select("docs", "answers")
    return joined.mapInArrow(released(_score(stats, ends)), RESULT)
