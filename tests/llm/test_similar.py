import random

import numpy as np
import zstandard

from quire.llm import _similar, simhash

from .helpers import documents, frame
from .test_simhash import brute_components, whole_rows


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def rows_with_copies(seed=11):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(30, 400))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):  # a changed word takes five shingles of n - 4; 2 % changed words are near the limit
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, len(copy) * rng.choice([1, 2, 3]) // 100)):
                copy[at] = word()
            rows.append((10 * k + c, " ".join(copy)))
    return [(i, t, "en", "s", 0, 0, "") for i, t in rows]


def test_pairs_at_the_limit_are_found(spark):
    rows = rows_with_copies()
    sets = [brute_set(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    assert 60 < len(pairs) and any(len(sets[i] & sets[j]) < 0.85 * len(sets[i] | sets[j]) for i, j in pairs)
    roots = brute_components(len(rows), pairs)
    out = simhash.similar_deduplicated(frame(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == sorted({rows[k][0] for k in roots})


def test_dense_buckets_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(_similar, "RUN", 3)
    rows = rows_with_copies(4)[:80]
    sets = [brute_set(r[1]) for r in rows]
    roots = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    assert sorted(r.doc_id for r in simhash.similar_deduplicated(frame(spark, rows)).collect()) == sorted({rows[k][0] for k in roots})


def test_bucket_links_match_brute_force():
    rows = rows_with_copies(6)
    rng = np.random.default_rng(6)
    key = rng.integers(0, 4, len(rows))
    sets = [_similar.shingles(r[1].encode()) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (key[k], len(sets[k])))
    keys = np.stack([key[order]] * 3)
    component = rng.integers(0, 200, len(rows))
    sim = np.array([_similar.fingerprint(sets[k]) for k in order], np.uint64).view(np.int64)
    sig = np.stack([_similar.minima(sets[k]) & np.uint64(255) for k in order]).astype(np.uint8)
    packer = zstandard.ZstdCompressor()
    texts = [packer.compress(rows[k][1].encode()) for k in order]
    size = np.array([len(sets[k]) for k in order])
    found = _similar.bucket_links(keys, size, sim, component, sig, texts, 0.8)
    plain = [brute_set(rows[k][1]) for k in order]
    same = [(i, j) for i in range(len(rows)) for j in range(i) if component[i] == component[j]]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if keys[0, i] == keys[0, j] and similar(plain[i], plain[j])]
    assert all((max(p), min(p)) in pairs for p in found) and len(found) > 10
    assert brute_components(len(rows), [*same, *found]) == brute_components(len(rows), [*same, *pairs])


def test_awkward_rows(spark):
    rows = documents()
    sets = [brute_set(r[1]) for r in rows]
    roots = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    out = simhash.similar_deduplicated(frame(spark))
    assert out.columns == frame(spark).columns
    assert whole_rows(out.collect(), rows, roots) == set(roots)
    assert simhash.similar_deduplicated(frame(spark, [])).count() == 0


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "one two three four five six seven" if k < 3 else f"t{k} " * 9, 1, 2, 3, 4, 5, 6) for k in range(6)], "doc_id long, text string, fp int, n int, sim int, sig int, component int, block int")
    out = simhash.similar_deduplicated(docs)
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 5]
    assert simhash.deduplicated(docs).columns == docs.columns and simhash.similar_deduplicated(docs.limit(0)).count() == 0
