import random

import numpy as np
import pytest

from quire.llm import decontam

from .helpers import documents, frame, prose

VOCABULARY = [a + b for a in "ba co di fu ge hi jo ku la me".split() for b in "rent tion sal mer pol ven".split()]


def words(text):
    return decontam.folded((text or "").encode()).split()


def brute(text, item, similarity=0.8):
    """The least edit distance of the item to any stretch of the text, if it is within the allowed edits."""
    number = {w: k for k, w in enumerate(dict.fromkeys([*words(text), *words(item)]))}
    x, t = (np.array([number[w] for w in words(s)], np.int64) for s in (item, text))
    d = decontam.best_stretch(x, t)[0] if len(x) else None
    return d if d is not None and d <= decontam.edits(len(x), similarity) else None


def slow_distance(item, text):
    best = len(item)
    for i in range(len(text) + 1):
        row = list(range(len(item) + 1))
        best = min(best, row[-1])
        for w in text[i:]:
            new = [row[0] + 1]
            for k, x in enumerate(item, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != w)))
            row = new
            best = min(best, row[-1])
    return best


def test_best_stretch():
    rng = random.Random(4)
    for _ in range(40):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 9))]
        assert decontam.best_stretch(np.array(item), np.array(text, np.int64))[0] == slow_distance(item, text)


def planted(seed=9):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(k, " ".join(some(rng.randint(12, 50)))) for k in range(30)]
    docs = []
    for k in range(300):
        body = some(rng.randint(0, 120))
        if k % 3:
            item = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randint(0, decontam.edits(len(item), 0.8)) if k % 3 == 1 else 0):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [item[at], rng.choice(VOCABULARY)]])
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() + "," if rng.random() < 0.2 else w for w in item]
        docs.append((k, " ".join(body), "en", "s", 0, 0, ""))
    return docs, items


def test_recall_and_precision_on_planted_edits(spark):
    docs, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(frame(spark, docs), bench).collect()}
    assert len(got) == len(docs)
    truth, hit = 0, 0
    for doc, text, *_ in docs:
        near = {i: d for i, t in items if (d := brute(text, t)) is not None}
        r = got[doc]
        if r.contaminated:
            assert r.item_id in near and r.distance >= near[r.item_id]
        truth += bool(near)
        hit += bool(near) and r.contaminated
        if 0 in near.values():
            assert r.contaminated and r.distance == 0
    assert truth > 180 and hit / truth >= 0.97


def test_blocks_of_items_give_the_same(spark):
    docs, items = planted(2)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    one = decontam.contamination(frame(spark, docs), bench)
    many = decontam.contamination(frame(spark, docs), bench, item_words=300)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    kept = {r.doc_id for r in decontam.cleaned(frame(spark, docs), bench, item_words=300).collect()}
    assert len(kept ^ {r.doc_id for r in many.collect() if not r.contaminated}) == 0


def test_awkward_rows(spark):
    rng = random.Random(1)
    item = prose(rng, 25)
    rows = documents() + [(900, "x " + item.upper() + " y", "en", "s", 1, 1, "u")] * 2
    bench = spark.createDataFrame([(7, item, 1), (7, item, 2), (None, None, 3), (8, "", 4)], "item_id long, text string, doc_id int")
    out = decontam.contamination(frame(spark, rows), bench).collect()
    assert len(out) == len(rows)
    assert [tuple(r) for r in out if r.doc_id == 900] == [(900, True, 2, 7, 0, 1.0)] * 2
    kept = decontam.cleaned(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id = 900").count() == 0
    empty = bench.limit(0)
    assert decontam.contamination(frame(spark, rows), empty).where("contaminated").count() == 0
    assert decontam.contamination(frame(spark, []), bench).count() == 0


def at_the_limit(n, kind, place, rng):
    """An item of n words and a copy with as many edits as are allowed, in a part of it."""
    item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    part = {"front": range(n // 2), "random": range(n), "back": range(n - n // 2, n)}[place]
    copy = list(item)
    for at in sorted(rng.sample(part, decontam.edits(n, 0.8)), reverse=True):
        copy[at : at + 1] = {"sub": [f"x{rng.randrange(10**6)}"], "del": [], "ins": [copy[at], f"x{rng.randrange(10**6)}"]}[kind]
    around = [f"y{rng.randrange(10**6)}" for _ in range(2 * n)]
    return " ".join(item).encode(), " ".join(around[:n] + copy + around[n:]).encode()


@pytest.mark.parametrize("n", [10, 15, 30, 60, 150])
def test_recall_at_the_limit(n):
    """At least 0.95 of 60 pairs at exactly the allowed distance, for every kind of edit and place."""
    rng = random.Random(n)
    for kind in ("sub", "ins", "del"):
        for place in ("front", "random", "back"):
            pairs = [at_the_limit(n, kind, place, rng) for _ in range(60)]
            index = decontam.Index([(k, item) for k, (item, _) in enumerate(pairs)], 0.8)
            found = index.matches([text for _, text in pairs])
            hit = sum((k, k) in found for k in range(len(pairs)))
            assert hit >= 0.95 * len(pairs), (n, kind, place, hit)


def test_best_stretches_agree_with_best_stretch():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 50)
    items = np.where(np.arange(8) < sizes[:, None], rng.integers(1, 5, (50, 8)), -1)
    texts = rng.integers(0, 5, (50, 15))
    assert decontam.best_stretches(items, sizes, texts).tolist() == [decontam.best_stretch(x[:n], t)[0] for x, n, t in zip(items, sizes, texts)]


def test_clashing_names(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, 25)) for k in range(4)]
    docs = spark.createDataFrame([(k, ("a b c " + items[k][1]) if k < 2 else None if k == 5 else f"clean text {k}", 1, 2, 3, 4, None) for k in range(8)], "doc_id long, text string, _text int, `row` int, block int, c0 int, items string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontam.ITEM_WORDS, 30):  # one block of items, and several
        out = decontam.cleaned(docs, bench, item_words=words)
        assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 5, 6, 7]
        assert {(r.doc_id, r.contaminated) for r in decontam.contamination(docs, bench, item_words=words).collect()} == {(k, k < 2) for k in range(8)}
    assert out.where("doc_id = 5 AND text IS NULL AND _text = 1 AND c0 = 4").count() == 1
