import numpy as np
import xxhash

from quire.llm import _graph, simhash

from .helpers import documents, frame


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def noisy(seed=1, base=150, near=350):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**63, base).astype(np.uint64)
    for _ in range(near):
        x = int(v[rng.integers(len(v))])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        v = np.append(v, np.uint64(x))
    return np.unique(v)


def test_bit_slices_and_forest():
    v = noisy()
    vertical = np.concatenate([simhash.planes(v), np.zeros((64, 2), np.uint64)], axis=1)
    for d in (1, 2, 63, 64, 65, 130, len(v) - 1):
        lanes = np.arange(0, len(v) - d, 3)
        assert simhash.within(vertical, lanes, d, 4).tolist() == [i for i in lanes.tolist() if (int(v[i]) ^ int(v[i + d])).bit_count() <= 4]
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    expected = brute_components(len(v), [(i, j) for i in range(len(v)) for j in range(i) if near[i, j]])
    assert brute_components(len(v), simhash.forest(v, np.full(len(v), len(v)))) == expected


def test_forest_keeps_buckets_apart():
    v = noisy(8)
    rng = np.random.default_rng(3)
    cuts = np.unique(np.append(rng.integers(1, len(v), 40), len(v)))
    ends = np.repeat(cuts, np.diff(cuts, prepend=0))
    expected = brute_components(len(v), [(i, j) for i in range(len(v)) for j in range(i) if ends[i] == ends[j] and (int(v[i]) ^ int(v[j])).bit_count() <= 4])
    found = simhash.forest(v, ends)
    assert brute_components(len(v), found) == expected
    assert len(found) == len(v) - len(set(expected))  # a forest, never all pairs


def test_plan_never_loses_a_pair():
    rng = np.random.default_rng(2)
    for n in (10, 10**5, 10**7, 10**10):
        masks, choices = simhash.plan(n)
        assert sum(masks) == 2**64 - 1
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(all(not diff & masks[i] for i in c) for c in choices)


def test_links_over_spark(spark):
    v = noisy(5)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    table = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    comps = {r.node: r.component for r in _graph.components(simhash.links(table), "a", "b").collect()}
    assert comps == {r.node: r.component for r in _graph.components(simhash.links(table, tile=3), "a", "b").collect()}  # dense buckets over several tasks
    signed = v.view(np.int64).tolist()
    order = np.argsort(v.view(np.int64))
    rank = {int(i): k for k, i in enumerate(order)}
    roots = brute_components(len(v), [(rank[i], rank[j]) for i in range(len(v)) for j in range(i) if near[i, j]])
    by_rank = [signed[i] for i in order]
    assert {x: comps.get(x, x) for x in signed} == {by_rank[k]: by_rank[r] for k, r in enumerate(roots)}


def test_near_duplicates_match_brute_force(spark):
    rows = documents()
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    expected = sorted(((r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots)), key=repr)
    out = simhash.near_duplicates(frame(spark))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected
    assert whole_rows(simhash.deduplicated(frame(spark)).collect(), rows, roots) == set(roots)


def whole_rows(out, rows, roots):
    """The groups that out has one row of, each a row of the least id of its group; fails on any other row."""
    left = [tuple(r) for r in out]
    found = set()
    for group in sorted(set(roots)):
        members = [r for r, root in zip(rows, roots) if root == group]
        least = min((r[0] for r in members if r[0] is not None), default=None)
        mine = [r for r in left if r in members]
        assert len(mine) == 1 and mine[0][0] == least
        found.add(group)
        left.remove(mine[0])
    assert not left
    return found


def test_deduplicated_by_row_where_ids_repeat(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    for texts in ([(1, a), (5, a), (5, b)], [(1, a), (1, a), (2, b)], [(None, a), (None, a), (None, b)]):
        rows = [(i, t, "en", "s", 0, 0, "") for i, t in texts]
        kept = simhash.deduplicated(frame(spark, rows)).collect()
        assert sorted(r.text for r in kept) == [a, b]


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
