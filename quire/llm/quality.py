"""Document quality by hierarchical empirical Bayes over sites.

1. A logistic classifier over the shapes of a text's words (case, symbols,
   repetition, length) is fitted on a bounded sample of labelled rows; its
   log-odds less those of the training prior are a document's own evidence.
2. Expected numbers of good documents are summed per path (host and section)
   by a grouped aggregation, and paths to hosts and hosts to the whole. Rates
   are shrunk: a host's towards the global rate, a path's towards its host's,
   each with a strength from the spread between the groups (method of moments).
   Sparse sites so fall back to what lies above them.
3. A document's log-odds are its evidence plus the log-odds of its path's rate
   without the document itself; rows under the threshold are rejected.

Texts are scored once, where they lie, and never shuffled: sites are joined to
ids or row numbers and log-odds, and `filtered` tells the stored blocks which
rows go.

Defined cases: null and empty texts have no words and are scored by the rates
and the classifier's constant. A null host or path is a site of its own. Null
labels are ignored; of several labels for an id the lowest counts. Without
usable labels of both classes the evidence of every text is 0 and the global
rate is that of the labels, or 1. Rows that repeat an id are scored each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _rows
from ._store import held_out, keep, released, small_batches
from ._words import Words, blocks

MAX_ROWS = 20_000
THRESHOLD = 0.5
#: Site rates stay this far from 0 and 1, so that a site alone never decides against clear evidence.
RATE_MARGIN = 0.1
#: The evidence of one text is held within these log-odds when rates are estimated and combined.
EVIDENCE_LIMIT = 12.0
#: Bytes of text whose words are held at once.
PART_BYTES = 1 << 20

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_PLAIN_END = np.array([_LETTER[b] or chr(b) in ".,;:?'\")" or 48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([not _LETTER[b] and not _DIGIT[b] and chr(b) not in ".,;:?!'\"()-\t\n\r\x0b\x0c " for b in range(256)])

FEATURES = (
    "words log2", "distinct share", "top word share", "repeats of the previous word", "words without letters", "words of capitals", "words with an odd end",
    "symbols in words", "doubled marks", "digits", "mean word length", "long words", "repeated pairs", "distinct pairs share",
)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES per text."""
    words = Words(texts, lower=False)
    n_docs, doc = len(texts), words.doc_of()
    n = np.diff(words.doc_first).astype(float)
    d = np.maximum(n, 1)
    lens = words.ends - words.starts
    add = lambda x: np.bincount(doc, x, n_docs)

    def inside(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[words.buf], dtype=np.int64)])
        return c[words.ends] - c[words.starts]

    letters, upper, digits, symbols = inside(_LETTER), inside(_UPPER), inside(_DIGIT), inside(_SYMBOL)
    last, before = words.buf[words.ends - 1], words.buf[np.maximum(words.ends - 2, 0)]
    pair_doc, pair_form, pair_n = words.pairs()
    top = np.zeros(n_docs)
    np.maximum.at(top, pair_doc, pair_n)
    same = np.zeros(len(doc), bool)
    same[1:] = (words.inverse[1:] == words.inverse[:-1]) & (doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        key = words.keys[words.inverse]
        follow = (key[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ key[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
        mixed = np.sort((follow[inner] >> np.uint64(24)) | (doc[1:][inner].astype(np.uint64) << np.uint64(40)))
    new = np.concatenate([[True], mixed[1:] != mixed[:-1]]) if len(mixed) else np.zeros(0, bool)
    distinct_pairs = np.bincount((mixed[new] >> np.uint64(40)).astype(np.int64), minlength=n_docs)
    pairs = np.maximum(n - 1, 1)
    share = np.where(n > 1, distinct_pairs / pairs, 1.0)
    return np.stack(
        [
            np.log2(n + 1) / 10, np.bincount(pair_doc, minlength=n_docs) / d, top / d, add(same) / d, add(letters == 0) / d,
            add((upper == letters) & (letters >= 2)) / d, add(~_PLAIN_END[last]) / d, add(symbols > 0) / d, add((last == before) & (lens > 2) & ~_LETTER[last]) / d,
            add(digits) / np.maximum(add(lens), 1), add(lens) / d / 10, add(lens > 30) / d, 1 - share, share**4,
        ],
        axis=1,
    )


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio of good against bad, from the text alone."""
        part = np.cumsum([len(t) + 16 for t in texts]) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
        found = [expand((features(texts[a:b]) - self.mean) / self.scale) @ self.weights for a, b in itertools.pairwise(cuts)]
        return np.clip(np.concatenate(found or [np.zeros(0)]) - self.prior, -EVIDENCE_LIMIT, EVIDENCE_LIMIT)


def expand(x: np.ndarray) -> np.ndarray:
    """Adds a constant and squares to standardised features."""
    x = np.clip(x, -8, 8)
    return np.concatenate([np.ones((len(x), 1)), x, x**2 / 4], axis=1)


def fit(y: np.ndarray, x: np.ndarray, l2: float = 1e-3, rounds: int = 40) -> Model:
    """Newton steps for a logistic model with ridge penalty."""
    width = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = expand((x - mean) / scale)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), l2 * len(y))
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    rate = y.mean()
    return Model(mean, scale, w, float(np.log(rate / (1 - rate))))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, ["quality"]):
        x = features(block["text"])
        yield pa.RecordBatch.from_arrays([pa.array(block["quality"], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_ROWS) -> tuple[Model, float]:
    """The classifier, and the labels' rate of good rows; from at most max_rows rows, those with the least hashes of their ids."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0)).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    sample = known.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "_id").select("quality", "text")
    found = rows.mapInArrow(released(_sampled), "quality int, x array<double>").toPandas()
    y = found["quality"].to_numpy(float)
    x = np.array(found["x"].tolist(), float).reshape(len(y), len(FEATURES))
    return fit(y, x), float(y.mean()) if len(y) else 1.0


def _scored(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            schema = pa.schema([*(first.schema.field(c) for c in columns), pa.field("_evidence", pa.float64())])
            for block in blocks(itertools.chain([first], batches), columns, text="_text"):
                yield pa.RecordBatch.from_pydict({**{c: block[c] for c in columns}, "_evidence": model.evidence(block["_text"])}, schema=schema)

    return run


def rates(sites: DataFrame, prior: float) -> DataFrame:
    """(_host, _path, n, good) of every path -> adds host_rate, path_rate and path_strength.

    good: expected good documents; the strengths follow the method of moments
    for a beta distribution of rates, weighted by documents.
    """

    def strength(groups: DataFrame, rate, mean) -> float:
        row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(rate - mean, 2)).alias("between"), F.sum(mean * (1 - mean)).alias("noise"), F.sum(F.col("n") * mean * (1 - mean)).alias("spread"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
        if not row.n or row.k < 2 or not row.spread:
            return 1e3
        tau = max(row.between - row.noise, 0.0) / max(row.n - row.squares / row.n, 1.0)
        return min(max(row.spread / row.n / max(tau, 1e-9) - 1, 1.0), 1e4)

    total = sites.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total.good + prior * 10) / (total.n + 10) if total.n else prior
    overall = min(max(overall, 1e-3), 1 - 1e-3)
    hosts = keep(sites.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    k = strength(hosts, F.col("good") / F.col("n"), F.lit(overall))
    hosts = hosts.select("_host", ((F.col("good") + k * overall) / (F.col("n") + k)).alias("host_rate"))
    joined = keep(sites.join(hosts, "_host"), "sites")
    k = strength(joined, F.col("good") / F.col("n"), F.col("host_rate"))
    return joined.withColumn("path_rate", (F.col("good") + F.lit(k) * F.col("host_rate")) / (F.col("n") + k)).withColumn("path_strength", F.lit(float(k)))


def _odds(p):
    p = F.least(F.greatest(p, F.lit(RATE_MARGIN)), F.lit(1 - RATE_MARGIN))
    return F.log(p / (1 - p))


def _site(host: str, path: str | None) -> dict:
    return {"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_path": F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")}


def rated(rows: DataFrame, rate: float) -> DataFrame:
    """Adds host_rate, path_rate and score to a kept table with _host, _path and _evidence; rate: of good rows among the labels."""
    prior = float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    good = 1 / (1 + F.exp(-(F.col("_evidence") + prior)))
    sites = keep(rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")), "paths")
    joined = rows.join(keep(rates(sites, rate), "rates"), ["_host", "_path"])
    others = (F.col("good") - good + F.col("path_strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("path_strength"))
    return joined.withColumn("score", 1 / (1 + F.exp(-(F.col("_evidence") + _odds(others)))))


def scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str | None = "lang", text: str = "text", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, evidence (log-odds), host_rate, path_rate, score (probability of good), kept."""
    small_batches(docs.sparkSession)
    model, rate = train(docs, labels, text, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in _site(host, path).items()), F.col(text).cast("string").alias("_text"))
    scored = rows.mapInArrow(released(_scored(model, ["doc_id", "_host", "_path"])), "doc_id long, _host string, _path string, _evidence double")
    out = rated(keep(scored, "scored"), rate)
    return out.select("doc_id", F.col("_evidence").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))


def filtered(docs: DataFrame, labels: DataFrame, host: str = "source", path: str | None = "lang", text: str = "text", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that are rejected, with all their columns."""
    model, rate = train(docs, labels, text, max_rows)
    column = docs.columns.index(text)

    def side(part: pa.RecordBatch) -> dict[str, list]:
        texts = [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
        return {"_host": part.column("_host"), "_path": part.column("_path"), "_evidence": model.evidence(texts)}

    stored = _rows.store(docs, _site(host, path), side, {"_host": "string", "_path": "string", "_evidence": "double"})
    return stored.without(rated(stored.narrow(), rate).where(F.col("score") < threshold).select("block", "row"))
