import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quire.llm import lexical

from .helpers import SCHEMA, documents, frame, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, k):
    docs = [(r[0], Counter(TERM.findall((r[1] or "").translate(LOW)))) for r in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if x[1] else x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def stated(spark, items):
    return spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, text string, doc_id string")


def items(rng, rows):
    out = [(k, prose(rng, rng.randint(1, 12))) for k in range(15)]
    out += [(100, rows[3][1]), (101, None), (102, "  --- "), (103, "unheardof wordthat"), (104, "THE the The"), (105, "ÄÖ straße É"), (105, "x" * 5000), (None, "kappa lambda")]
    return out


@pytest.mark.parametrize("k,stride,size,first", [(5, 16, 3000, 2), (50, 4096, 8 << 20, 24), (3, 64, 600, 0), (1000, 8, 2000, 1)])
def test_search_is_brute_force(spark, monkeypatch, k, stride, size, first):
    monkeypatch.setattr(lexical, "STRIDE", stride)
    monkeypatch.setattr(lexical, "FIRST_BLOCKS", first)
    monkeypatch.setattr(lexical, "INDEX_BYTES", size)
    rows = documents(n=200)
    asked = items(random.Random(5), rows)
    out = lexical.search(lexical.indexed(frame(spark, rows)), stated(spark, asked), k)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == brute(rows, asked, k)


def test_queries_in_blocks(spark, monkeypatch):
    rows = documents(n=120)
    asked = items(random.Random(9), rows)
    index = lexical.indexed(frame(spark, rows))
    whole = sorted(map(str, lexical.search(index, stated(spark, asked), 7).collect()))
    monkeypatch.setattr(lexical, "QUERIES", 4)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 30)
    assert len(list(lexical.query_blocks(stated(spark, asked)))) > 5
    assert sorted(map(str, lexical.search(index, stated(spark, asked), 7).collect())) == whole


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert lexical.search(lexical.indexed(empty), stated(spark, [(1, "the")])).count() == 0
    assert lexical.search(lexical.indexed(frame(spark)), stated(spark, [])).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " - ")], "doc_id long, text string")
    assert lexical.search(lexical.indexed(blank), stated(spark, [(1, "the")])).count() == 0


def postings(texts, weights=None):
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 0

    import pyspark

    held = pyspark.TaskContext.get
    pyspark.TaskContext.get = classmethod(lambda cls: Task())
    try:
        batch = next(lexical._indexer(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])])))
    finally:
        pyspark.TaskContext.get = held
    row = batch.to_pylist()[0]
    names = sorted({t for text in texts for t in lexical.terms(text.encode())})
    numbers = {t: k for k, t in enumerate(names)}
    df = Counter(t for text in texts for t in set(lexical.terms(text.encode())))
    weighed = np.array([lexical.weight(row["n_docs"], df[t]) for t in names], np.int64)
    return lexical.Postings(row, numbers, weighed, row["n_docs"], row["n_terms"]), numbers


def test_groups_have_one_impact_each_and_fall(spark):
    rng = random.Random(1)
    block, _ = postings([prose(rng, rng.randint(5, 60)) for _ in range(300)])
    for number, (impacts, firsts, sizes) in block.groups.items():
        doc, impact = block.by_doc[number]
        by = dict(zip(doc.tolist(), impact.tolist(), strict=True))
        assert (np.diff(impacts) < 0).all() and sizes.sum() == len(doc)
        for value, at, n in zip(impacts, firsts, sizes, strict=True):
            assert {by[d] for d in block.ordered[at : at + n].tolist()} == {value}


def test_stops_before_all_postings_are_added(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(3000)]
    for k in range(30):
        texts[k * 7] += " needle haystack pin"
    block, numbers = postings(texts)
    monkeypatch.setattr(lexical, "STRIDE", 64)
    added = []
    monkeypatch.setattr(lexical, "_ranges", lambda starts, sizes, f=lexical._ranges: added.append(int(sizes.sum())) or f(starts, sizes))
    query = sorted(numbers[t] for t in (b"needle", b"haystack", b"pin", b"the", b"of"))
    places, scores = block.best(query, 10, 0)
    every = sum(len(block.by_doc[t][0]) for t in query)
    assert sum(added) < every / 2 and 10 <= len(places) and (scores > 0).all()
    del added[:]
    assert len(block.best(query, 10, 10**15)[0]) == 0 and not added  # a bound that no document can reach: nothing is added
