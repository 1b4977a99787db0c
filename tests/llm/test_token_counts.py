from quire.llm import _lattice, token_counts

from .helpers import documents, frame


def brute(word, table, longest):
    best = [(0.0, 0)] + [(-1e300, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for k in range(1, min(j, longest) + 1):
            p = table.get(word[j - k : j])
            if p is not None:
                s, n = best[j - k][0] + p, best[j - k][1] + 1
                if s > best[j][0] or s == best[j][0] and n < best[j][1]:
                    best[j] = s, n
    return best[-1][1]


def test_counts_match_brute_force(spark):
    pieces = _lattice.pieces(_lattice.default_path())
    table = dict(zip(pieces.bytes_, pieces.prior.tolist()))
    cache = {}
    expected = []
    for r in documents():
        words = (r[1] or "").encode().split()
        for w in words:
            cache.setdefault(w, brute(b" " + w, table, pieces.longest))
        expected.append((r[0], len(words), sum(cache[w] for w in words)))
    out = token_counts.token_counts(frame(spark))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(expected, key=repr)


def test_prefixes_are_scored_once():
    trie = token_counts.Trie(_lattice.pieces(_lattice.default_path()))
    words = (b" inter", b" internal", b" international", b" internet")
    for w in words:
        trie.insert(w)
    assert trie.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_empty_table(spark):
    assert token_counts.token_counts(frame(spark, [])).count() == 0
