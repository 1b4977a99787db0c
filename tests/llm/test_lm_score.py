import math
from collections import Counter

import numpy as np
import pytest

from quire.llm import _lattice, lm_score

from .helpers import documents, frame, held


def brute_total(word, ids, logp):
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        alpha[j] = np.logaddexp.reduce([alpha[i] + logp[ids[word[i:j]]] for i in range(j) if word[i:j] in ids])
    return alpha[-1]


def test_lattice_totals_and_expectations():
    pieces = _lattice.pieces(_lattice.default_path())
    logp, ids = pieces.prior, pieces.ids
    words = [b"international", b"the", b"zq", "straße".encode(), b"x" * 60, b"a"]
    for got, word in zip(pieces.totals(words, logp), words):
        assert got == pytest.approx(brute_total(b" " + word, ids, logp), rel=1e-9)
    # the derivative of the log total by a log weight is the piece's expected use
    uses = pieces.expectations([b"international"], logp)
    k = ids[b" inter"]
    up, down = logp.copy(), logp.copy()
    up[k] += 1e-5
    down[k] -= 1e-5
    slope = (brute_total(b" international", ids, up) - brute_total(b" international", ids, down)) / 2e-5
    assert uses[k] == pytest.approx(slope, abs=1e-6)


def test_scores_match_brute_force(spark):
    rows = documents()
    tokens = [(r[1] or "").encode().lower().split() for r in rows]
    train = [not held(r[0], 1) for r in rows]
    c = Counter(t for ts, keep in zip(tokens, train) if keep for t in [*ts, None])
    n, v = sum(c.values()), len(c)
    got = sorted((tuple(r) for r in lm_score.scores(frame(spark)).collect()), key=repr)
    expected = []
    for r, ts in zip(rows, tokens):
        ts = [*ts, None]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        expected.append((r[0], held(r[0], 1), len(ts), sum(c[t] > 0 for t in ts), n, base))
    expected.sort(key=repr)
    key = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] < 0 and math.isfinite(a[6])


def test_expectations_of_long_words_agree_with_short_ones():
    pieces = _lattice.pieces(_lattice.default_path())
    for word in (b"international", "größte".encode()):
        one = np.zeros(len(pieces.prior))
        pieces.expected_one(b" " + word, pieces.prior, one)
        assert one == pytest.approx(pieces.expectations([word], pieces.prior), abs=1e-9)
    long = ("漢字かな交じり文" * 5).encode()
    uses = pieces.expectations([long], pieces.prior)
    assert sum(u * len(b) for u, b in zip(uses, pieces.bytes_)) == pytest.approx(len(long) + 1)  # every byte once


def urn(a, p, words):
    """The probability of words in turn, each drawn from the model or from the words before."""
    out, seen = 1.0, Counter()
    for k, t in enumerate(words):
        out *= p(t) if a == math.inf else (a * p(t) + seen[t]) / (a + k)
        seen[t] += 1
    return out


def test_log_gamma():
    x = np.array([1e-9, 0.3, 1.0, 7.5, 1e5])
    assert lm_score.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-7, abs=1e-8)


def test_whole_model_matches_brute_force_on_one_language(spark):
    rows = [(1, "a b a", "en", None, 1, 1, ""), (2, "b c", "en", None, 1, 1, ""), (3, "a zq", None, None, 1, 1, "")]
    rows = [r for r in rows if not held(r[0], 1)]
    logp = _lattice.pieces(_lattice.default_path())
    docs = frame(spark, rows)
    got = {r.doc_id: r.score for r in lm_score.scores(docs, rounds=0).collect()}
    weights = logp.prior + math.log1p(-lm_score.END)
    tokens = {r[0]: [*r[1].encode().split(), None] for r in rows}
    groups = {r[0]: r[2] for r in rows}

    def model(counts, below):
        n1, n2 = (sum(c == k for c in counts.values()) - (counts.get(None) == k) for k in (1, 2))  # ends aside
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        n = sum(counts.values())
        return lambda t: (max(counts.get(t, 0) - d, 0) + d * len(counts) * below(t)) / n

    lattice = lambda t: lm_score.END if t is None else math.exp(brute_total(b" " + t, logp.ids, weights))
    every = model(Counter(t for ts in tokens.values() for t in ts), lattice)
    for doc, ts in tokens.items():
        total = 0
        for g in set(groups.values()):
            own = [d for d in tokens if groups[d] == g]
            p = model(Counter(t for d in own for t in tokens[d]), every)
            for a in (math.inf, *lm_score.URNS):
                total += len(own) / len(tokens) / (1 + len(lm_score.URNS)) * urn(a, p, ts[:-1]) * p(None)
        assert got[doc] == pytest.approx(math.log10(total), rel=1e-5)


def test_model_beats_the_base_on_the_whole_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lm_score.scores(docs).where("held_out").collect()
    assert len(rows) > 1500 and sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.98


def test_empty_table(spark):
    assert lm_score.scores(frame(spark, [])).count() == 0
