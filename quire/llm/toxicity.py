"""Toxicity scores by a counterfactually regularised classifier.

A logistic model over the words of a text (letters only, A-Z lower-cased), their
beginnings, and how often these occur, is fitted on a bounded sample of labelled
rows; the features are those whose rates differ most between the classes, found
by a grouped aggregation. In the sample's sentences, each identity term is
swapped for a neutral word and for other terms of its kind; both sentences are
scored at every step of the fit, and the mean squared change of the score is
penalised, so that a mention of a group weighs as little as any other and naming
it neutrally does not raise a score. The terms are a parameter. Swaps that change no feature of
the model cannot change a score; `Model.live_swaps` counts the others. Where no
labelled sentence holds a term there are none, and the model is a logistic one.

Only `labels.toxic` of rows whose crc32(doc_id as text) mod 5 is not 0 is
learned from; the text alone is scored. Every whole text is scored in one scan
without a shuffle; the model is at most `max_features` weights.

Defined cases: null and empty texts get the model's score for no words. A null
or repeated label row: null labels are ignored, and a document with several
labels is toxic if any is. Without usable labels of both classes every score is
the labels' rate of toxic rows, 0 if there are none. Rows that repeat an id are
scored each. Ids of labels without a document are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import held_out, keep, released, small_batches
from ._words import Words, blocks

MAX_ROWS, MAX_FEATURES = 20_000, 4_000
#: Standard deviations by which a feature's toxic rows differ from the common rate, at least.
LEAST_GAIN = 4.0
#: Bytes of the beginnings of words, and how often a word or beginning occurs in a text.
PREFIXES, LEVELS = (4, 5, 6, 7, 8), (1, 2, 4)
#: Swapped sentences that the model is fitted on, at most, and terms besides the neutral word that a term is swapped for.
MAX_SWAPS, OTHERS = 20_000, 3

# Identity terms by kind; the first of each kind is the neutral word.
IDENTITY = {
    "gender": "people women men woman man girl girls boy boys female male transgender nonbinary femme homme femmes hommes frau mann frauen männer mujer hombre mujeres hombres",
    "orientation": "people gay lesbian bisexual straight heterosexual homosexual queer",
    "religion": "people muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics protestant sikh musulman chrétien juif christ jude musulmán cristiano judío",
    "origin": "people black white asian african european american latino latina hispanic arab arabs mexican chinese indian immigrant immigrants refugee refugees foreigner foreigners",
    "ability": "people disabled deaf blind autistic",
    "age": "people old young elderly teenager",
}

_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def _kinds(identity: dict[str, str]) -> dict[bytes, tuple[list[bytes], list[bytes]]]:
    """Each term, with the neutral words and the other terms of its kinds."""
    out: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
    for terms in identity.values():
        neutral, *names = (t.encode().lower() for t in terms.split())
        for t in names:
            plain, others = out.setdefault(t, ([], []))
            plain.append(neutral)
            others += [x for x in names if x != t]
    return out


def swapped(text: bytes, kinds: dict[bytes, tuple[list[bytes], list[bytes]]], pattern: re.Pattern) -> Iterator[tuple[bytes, bytes]]:
    """(sentence, sentence with a term swapped) for the terms of a text: for every neutral word, and for OTHERS other terms that follow from the sentence."""
    lower = text.lower()
    if not pattern.search(lower):
        return
    for sentence in _SENTENCE.split(lower):
        for term in sorted(set(pattern.findall(sentence))):
            plain, others = kinds[term]
            others = sorted(set(others), key=lambda o: zlib.crc32(sentence + b" " + o))[:OTHERS]
            for other in dict.fromkeys([*plain, *others]):
                yield sentence, pattern.sub(lambda m: other if m[0] == term else m[0], sentence)  # noqa: B023


def _pattern(kinds: dict) -> re.Pattern:
    return re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, kinds), key=len, reverse=True)) + rb")(?![a-z\x80-\xff])")


def _form_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, 32-bit key) of each word and of its beginnings."""
    starts, lens = words.starts[words.first], (words.ends - words.starts)[words.first]
    lanes = np.ndarray((len(words.buf) - 7,), "<u8", words.buf.data, strides=(1,))[starts]
    forms, keys = [np.arange(len(starts))], [words.keys >> np.uint64(32)]
    for k in PREFIXES:
        long = np.flatnonzero(lens > k)
        with np.errstate(over="ignore"):
            h = ((lanes[long] & np.uint64((1 << 8 * k) - 1)) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        forms.append(long)
        keys.append(h >> np.uint64(32))
    return np.concatenate(forms), np.concatenate(keys)


def _cells(texts: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, words that have it), for all keys or those in `known` (sorted), which are then given by their index."""
    words = Words([t.translate(_LETTERS) for t in texts])
    form, key = _form_features(words)
    if known is not None:
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        good = np.flatnonzero(known[at] == key) if len(known) else np.zeros(0, np.int64)
        form, key = form[good], at[good].astype(np.uint64)
    order = np.argsort(form, kind="stable")
    form, key = form[order], key[order]
    first = np.searchsorted(form, np.arange(len(words.first) + 1))
    doc, pair_form, count = words.pairs()
    many = (first[1:] - first[:-1])[pair_form]
    rows = np.repeat(np.arange(len(doc)), many)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + first[pair_form[rows]]
    cell = (doc[rows].astype(np.uint64) << np.uint64(32)) | key[inner]
    by = np.argsort(cell)
    cell = cell[by]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    counts = np.add.reduceat(count[rows[by]], new) if len(new) else np.zeros(0, np.int64)
    return (cell[new] >> np.uint64(32)).astype(np.int64), cell[new] & np.uint64(0xFFFFFFFF), counts


def _levels(counts: np.ndarray):
    """(level, cells that reach it)."""
    for level, least in enumerate(LEVELS):
        yield level, np.flatnonzero(counts >= least)


def _rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key and level, the labelled texts that have it and the toxic ones of them, summed over blocks."""
    for block in blocks(batches, ["toxic"]):
        toxic = np.array(block["toxic"], np.int64)
        doc, key, counts = _cells(block["text"])
        for level, rows in _levels(counts):
            keys, inverse = np.unique(key[rows], return_inverse=True)
            df = np.bincount(inverse, minlength=len(keys))
            pos = np.bincount(inverse, toxic[doc[rows]], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), level, np.int32)), pa.array(df), pa.array(pos)], names=["key", "level", "df", "pos"])


def _rows(known: np.ndarray):
    """Per labelled text: its label and its cells of known keys, as (index, count) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ["toxic"]):
            yield pa.RecordBatch.from_arrays([pa.array(block["toxic"], pa.int32()), pa.array(_packed(block["text"], known), pa.binary())], names=["toxic", "cells"])

    return run


def _packed(texts: list[bytes], known: np.ndarray) -> list[bytes]:
    """The cells of known keys of each text, as (index, count) pairs."""
    doc, key, counts = _cells(texts, known)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [np.stack([key[a:b].astype(np.uint32), np.minimum(counts[a:b], 255).astype(np.uint32)]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _swaps(known: np.ndarray, identity: dict[str, str]):
    """The cells of each labelled sentence and of its swapped forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds(identity)
        pattern = _pattern(kinds)
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                pairs = list(swapped(text or b"", kinds, pattern))
                if pairs:
                    sides = [_packed(list(side), known) for side in zip(*pairs, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in sides], names=["own", "other"])

    return run


class Model:
    """keys: sorted; weights: a row of one weight per level for each; bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, live_swaps: int = 0):
        self.keys, self.weights, self.bias, self.live_swaps = keys, weights, bias, live_swaps

    def scores(self, texts: list[bytes]) -> np.ndarray:
        doc, key, counts = _cells(texts, self.keys)
        logit = np.full(len(texts), self.bias)
        for level, rows in _levels(counts):
            logit += np.bincount(doc[rows], self.weights[key[rows].astype(np.int64), level], len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


class Design:
    """The features of a list of texts, sparse."""

    def __init__(self, cells: list[np.ndarray], place: np.ndarray):
        """cells: (index of key, count) of each text; place: the feature of each key and level, or -1."""
        flat = np.concatenate(cells, axis=1) if cells else np.zeros((2, 0), np.uint32)
        owner = np.repeat(np.arange(len(cells)), [c.shape[1] for c in cells])
        rows, features = [], []
        for level, at in _levels(flat[1]):
            f = place[flat[0][at].astype(np.int64), level]
            rows.append(owner[at][f >= 0])
            features.append(f[f >= 0])
        self.n, self.rows, self.features = len(cells), np.concatenate(rows), np.concatenate(features)

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.rows, w[self.features], self.n) + bias, -60, 60)))

    def pulled(self, by_row: np.ndarray, m: int) -> np.ndarray:
        """The gradient over m features of a sum whose derivative by each row's logit is given."""
        return np.bincount(self.features, by_row[self.rows], m)


def objective(w: np.ndarray, bias: float, y: np.ndarray, texts: Design, own: Design, other: Design, l2: float, swap_weight: float) -> tuple[float, np.ndarray]:
    """Mean log loss, ridge, and swap_weight times the mean squared change of the score of swapped sentences; its gradient, the bias last."""
    m = len(w)
    p = texts.scores(w, bias)
    loss = -float(np.mean(y * np.log(np.maximum(p, 1e-300)) + (1 - y) * np.log(np.maximum(1 - p, 1e-300)))) + l2 / 2 * float(w @ w)
    grad = np.append(texts.pulled((p - y) / len(y), m) + l2 * w, (p - y).mean())
    if own.n:
        a, b = own.scores(w, bias), other.scores(w, bias)
        loss += swap_weight * float(np.mean((a - b) ** 2))
        by_own, by_other = (2 * swap_weight / own.n * (a - b) * s * (1 - s) for s in (a, b))
        grad += np.append(own.pulled(by_own, m) - other.pulled(by_other, m), (by_own - by_other).sum())
    return loss, grad


def fit(labels: list[int], cells: list[np.ndarray], keys: np.ndarray, chosen: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], l2: float = 1e-5, swap_weight: float = 10.0, rounds: int = 300) -> Model:
    """cells: (index of key, count) of each text; chosen: for each key and level, is it a feature?; swaps: the cells of each sentence and of its swapped form."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        rate = y.mean() if len(y) else 0.0
        return Model(keys[:0], np.zeros((0, len(LEVELS))), float(np.log(max(rate, 1e-26) / max(1 - rate, 1e-26))))
    m = int(chosen.sum())
    place = np.full(chosen.shape, -1)
    place[chosen] = np.arange(m)
    live = [(a, b) for a, b in swaps if not np.array_equal(a, b)]
    texts, own, other = Design(cells, place), Design([a for a, _ in live], place), Design([b for _, b in live], place)
    rate = y.mean()
    w, bias = np.zeros(m), float(np.log(rate / (1 - rate)))
    g1, g2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        _, grad = objective(w, bias, y, texts, own, other, l2, swap_weight)
        g1 = 0.9 * g1 + 0.1 * grad
        g2 = 0.999 * g2 + 0.001 * grad**2
        step = 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-9)
        w -= step[:m]
        bias -= step[m]
    weights = np.zeros(chosen.shape)
    weights[chosen] = w
    return Model(keys, weights, bias, len(live))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, identity: dict[str, str] | None = None, max_swaps: int = MAX_SWAPS) -> Model:
    """Fits on at most max_rows labelled rows, those with the least hashes of their ids, and as many as max_swaps swaps of their sentences; identity: terms by kind, the first of each kind neutral (IDENTITY)."""
    identity = IDENTITY if identity is None else identity
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0)).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = known.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "_id").select("toxic", "text"), "labelled")
    n, positive = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("toxic")).first())
    if not 0 < positive < n:
        return fit([int(positive > 0)] * min(n, 1), [], np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)), bool), [])
    rate = positive / n
    gain = F.abs(F.col("pos") - F.col("df") * rate) / F.sqrt(F.col("df") * (rate * (1 - rate)) + 1)
    sums = rows.mapInArrow(released(_rates), "key long, level int, df long, pos long").groupBy("key", "level").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    best = sums.where(F.col("df") >= 3).select("key", "level", gain.alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "key", "level").limit(max_features).collect()
    keys = np.unique(np.array([r.key for r in best], np.uint64))
    chosen = np.zeros((len(keys), len(LEVELS)), bool)
    for r in best:
        chosen[np.searchsorted(keys, np.uint64(r.key)), r.level] = True
    y, cells = [], []
    for row in rows.mapInArrow(released(_rows(keys)), "toxic int, cells binary").toLocalIterator():
        y.append(row.toxic)
        cells.append(np.frombuffer(bytes(row.cells), np.uint32).reshape(2, -1))
    unpacked = lambda x: np.frombuffer(bytes(x), np.uint32).reshape(2, -1)
    pairs = rows.select("text").mapInArrow(released(_swaps(keys, identity)), "own binary, other binary").where("own <> other")
    pairs = pairs.orderBy(F.xxhash64("own", "other"), "own", "other").limit(max_swaps).collect() if any(len(t.split()) > 1 for t in identity.values()) else []
    return fit(y, cells, keys, chosen, [(unpacked(r.own), unpacked(r.other)) for r in pairs])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ["doc_id", "held_out"]):
            score = model.scores(block["text"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["doc_id"], pa.int64()), pa.array(block["held_out"], pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, identity: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, max_rows, max_features, identity)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(_scorer(model)), "doc_id long, held_out boolean, score double, predicted int")
