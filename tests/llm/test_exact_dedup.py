import hashlib
import itertools
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import _golomb, _rows, _store, exact_dedup, quality, simhash

from .helpers import SCHEMA, as_tuples, documents, frame

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 60))
def test_golomb_round_trip(values, shift):
    v = np.unique(np.array(sorted(values), np.uint64) >> np.uint64(shift))
    assert np.array_equal(_golomb.decode(_golomb.encode(v)), v)


def test_assignments_match_brute_force(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    expected = []
    for r in rows:
        text = (r[1] or "").translate(LOW)
        ids = groups[text]
        keep = max((i for i in ids if i is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert as_tuples(exact_dedup.assignments(frame(spark))) == sorted(expected, key=repr)


def test_deduplicated_keeps_whole_rows(spark):
    rows = documents()
    best = {}
    for r in rows:
        key = (r[1] or "").translate(LOW)
        if key not in best or (r[0] if r[0] is not None else -1) > (best[key][0] if best[key][0] is not None else -1):
            best[key] = r
    out = exact_dedup.deduplicated(frame(spark))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert as_tuples(out) == sorted(best.values(), key=repr)


def test_empty_table(spark):
    assert exact_dedup.assignments(frame(spark, [])).count() == 0
    assert exact_dedup.deduplicated(frame(spark, [])).count() == 0


def exchanged(df):
    """What goes into the exchanges of a plan, one text each."""
    text = df._sc._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = re.split(r"\n\n\(\d+\) ", text)
    return [p for p in parts if re.match(r"(Shuffle|Broadcast)?(Exchange|QueryStage)", p)]


def test_only_suspects_move_at_any_size(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were too large
    try:
        stored = exact_dedup._stored(frame(spark), "doc_id", "text", False)
        marks = exact_dedup.suspects(stored)
        plans = [exact_dedup.deduplicated(frame(spark)), exact_dedup.assignments(frame(spark)), stored.at(marks, lambda rows, block, at: rows, "block long"), simhash.deduplicated(frame(spark)), quality.filtered(frame(spark), spark.createDataFrame([], "doc_id long, quality int"))]
        for df in plans:
            found = exchanged(df)
            assert found and not [p for p in found if re.search(r"\b(rows|text|_quire_norm)#", p)]
        rows = documents()
        texts = [(r[1] or "").translate(LOW) for r in rows]
        twice = sorted(t.encode() for t in texts if texts.count(t) > 1)
        moved = exact_dedup._suspect_texts(stored, marks, "doc_id", "text").collect()
        assert sorted(bytes(r.norm) for r in moved) == twice
        assert exact_dedup.deduplicated(frame(spark)).count() == len(set(texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_columns_of_any_type_come_back(spark):
    docs = spark.sql("""SELECT id AS doc_id, concat('text ', id % 3) AS text, array(id, null) AS `rows`, map('k', id) AS block, named_struct('a', id, 'b', array('x')) AS s, timestamp'2020-01-01 00:00:01' AS t,
      date'2021-02-03' AS d, cast(id AS decimal(20, 3)) AS m, cast(cast(id AS string) AS binary) AS `a.b`, cast(null AS string) AS n, id % 2 = 0 AS flag, cast(id AS float) AS c0 FROM range(9)""").repartition(2)
    out = exact_dedup.deduplicated(docs)
    assert out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("doc_id > 5").collect()))


def test_blocks_of_a_task_fall_into_one_bucket(spark):
    for n, part in ((1, 0), (8, 3), (211, 5), (4, 1 << 18)):
        ids = list(itertools.islice(_rows.block_ids(part, n), 20))
        assert len(set(ids)) == 20
        found = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr(f"pmod(hash(i), {n}) AS b").distinct().collect()
        assert [r.b for r in found] == [part % n]


def test_cleanup_removes_tables_and_folders(spark):
    _store.cleanup(spark)
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.deduplicated(frame(spark)).count() > 0
    paths = _store.written()
    assert paths and {t.name for t in spark.catalog.listTables()} > before
    _store.cleanup(spark)
    assert _store.written() == [] and {t.name for t in spark.catalog.listTables()} == before and not any(Path(p).exists() for p in paths)
