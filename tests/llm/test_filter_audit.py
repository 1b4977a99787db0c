import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quire.llm import filter_audit

from .helpers import SCHEMA, documents, frame

LABELS = "doc_id long, quality int, toxic int, lang string"


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        c
        for c, bad in (
            ("A", len(words) < 100),
            ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)),
            ("D", re.search(r"[#$%&*|]", text) is not None),
        )
        if bad
    }


def brute(rows, labels):
    good, bad = ({i for i, q, t, _ in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    known = defaultdict(list)
    for r in rows:
        known[r[1] or ""].append(r[0])
    smaller = lambda a, b: a is not None and (b is None or a < b)
    docs = [(r[0], r[2] or "", failed(r[1] or "") | ({"E"} if any(smaller(i, r[0]) for i in known[r[1] or ""]) else set())) for r in rows]
    out = []
    for part in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == part]
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                here = [d for d in left if c in d[2]]
                left = [d for d in left if c not in d[2]]
                shapley[c] += len(here)
                fails = sum(c in d[2] for d in mine)
                steps.append((part, "".join(order), k + 1, len(left), len(here), fails - len(here), sum(d[2] == {c} for d in mine), sum(d[0] in good for d in here), sum(d[0] in bad for d in here)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def awkward():
    rows = documents()
    rows += [(2000 + i, f"#{i} " + " ".join(f"w{i}x{k}" for k in range(120)), "de" if i % 2 else "", None, None, None, None) for i in range(4)]
    rows += [(3000, "SHOUT " * 150, None, None, None, None, None), (3000, "SHOUT " * 150, "en", None, None, None, None), (2999, "SHOUT " * 150, "fr", None, None, None, None)]
    rows += [(None, "SHOUT " * 150, "fr", None, None, None, None), (3001, "ä\x0bb\x1fc\x85d e", "fr", None, None, None, None), (3002, "ÄÄÄÄÄÄÄÄÄZ", "fr", None, None, None, None)]
    return rows


@pytest.mark.parametrize("held", [filter_audit.HELD_BYTES, 2000])
def test_audit_is_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    rows = awkward()
    labels = [(r[0], k % 2, k % 3 == 0 or None, "zz") for k, r in enumerate(rows) if k % 4]
    labels = [(i, q, int(t) if t else t, z) for i, q, t, z in labels] + [(None, 1, 1, "zz"), (7, 1, 0, "zz"), (7, 0, 1, "zz"), (10**6, 1, 1, "zz")]
    out = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}".replace("bigint", "long") for f in out.schema) == filter_audit.RESULT
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, labels)


def test_a_group_of_copies_is_one_entry_a_task(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    sent = list(filter_audit._sender(tuple(filter_audit.RULES.values()))((r.doc_id, r.text.encode(), r.lang) for r in docs.collect()))
    assert sum(v[0] is not None for _, v in sent) == 2001 and len({k for k, v in sent if v[0] is None}) == 999
    found = filter_audit.failures(docs.repartition(5)).where("mask & 16 <> 0")
    assert sorted(r.doc_id for r in found.collect()) == list(range(3, 3000, 3))


def test_fingerprints_that_collide_keep_their_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda text, seed: 7)
    send, own = filter_audit._sender(()), filter_audit._owner(1)
    records = sorted([*send([(3, b"a", "x"), (2, b"b", "x"), (1, b"a", "y")]), *send([(2, b"a", "x"), (9, b"b", "z")])], key=lambda r: r[0])
    assert sorted(own(iter(records))) == [(1, "y", 0, 1), (2, "x", 0, 1), (2, "x", 1, 1), (3, "x", 1, 1), (9, "z", 1, 1)]


def test_own_rules_and_empty_table(spark):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    out = filter_audit.audit(frame(spark).withColumnRenamed("text", "body"), labels, text="body", part="source", rules={"X": lambda m: m.chars == 0}).collect()
    assert {r.filter_order for r in out} == {"XE", "EX"} and {r.part for r in out} == {"src0", "src1", ""}
    with pytest.raises(ValueError):
        filter_audit.audit(frame(spark), labels, rules={"E": lambda m: True})
