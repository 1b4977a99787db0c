import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffix_dedup

from .helpers import documents, frame, prose


def brute(rows, length=50):
    least = {}
    ids = [r[0] if r[0] is not None else 1 << 63 for r in rows]
    texts = [(r[1] or "").encode() for r in rows]
    for d, t in zip(ids, texts):
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for r, d, t in zip(rows, ids, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = True
        edges = np.diff(gone.astype(int), prepend=0)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((r[0], len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shared(seed=5):
    """Documents that share passages, lines and tails, with copies, runs of one byte and text beyond ASCII."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(6, 60)) for _ in range(8)] + ["é" * 60, "a" * 49, "b" * 51, "xy" * 40]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(0, 200))))
        rows.append((rng.randrange(500), "".join(parts), None, None, None, None, None))
    return rows + [(7, rows[3][1], None, None, None, None, None), (None, rows[3][1], None, None, None, None, None)]


@pytest.mark.parametrize("make", [documents, shared])
@pytest.mark.parametrize("block", [1 << 11, 8 << 20])
def test_matches_brute_force(spark, make, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rows = make()
    out = suffix_dedup.repeated_spans(frame(spark, rows))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def test_spans_and_kept_bytes(spark):
    rows = shared(6)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    for r in suffix_dedup.repeated_spans(frame(spark, rows), whole=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert len(r.spans) == r.n_spans and sum(s.length for s in r.spans) == r.n_removed
        assert any(b"".join(t[a:b] for a, b in zip([0, *(s.start + s.length for s in r.spans)], [*(s.start for s in r.spans), len(t)])) == r.kept for t in texts[r.doc_id])


def test_loser_tree_never_repeats_known_prefixes():
    rng = np.random.default_rng(3)
    runs, every = [], []
    for _ in range(7):
        rows = rng.integers(97, 99, (rng.integers(0, 40), 12)).astype(np.uint8)
        rows = rows[np.argsort(np.ascontiguousarray(rows).view("S12").ravel(), kind="stable")] if len(rows) else rows
        every += [r.tobytes() for r in rows]
        runs.append((rows, suffix_dedup.front_code(rows)))
        assert np.array_equal(suffix_dedup._unfold(*runs[-1][1], 12), rows)
    which, at, prefix = suffix_dedup.merge([r for _, r in runs], 12)
    merged = [runs[w][0][a].tobytes() for w, a in zip(which, at)]
    assert merged == sorted(every)
    for k in range(1, len(merged)):
        same = next((i for i in range(12) if merged[k][i] != merged[k - 1][i]), 12)
        assert prefix[k] == same


def test_empty_table(spark):
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0
