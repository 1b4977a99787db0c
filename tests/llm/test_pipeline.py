"""The corpus pipeline against a plain version of every stage, stage by stage."""

from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline as pipeline

from quire.llm import _store, decontam, exact_dedup, quality

from .helpers import as_tuples, documents, frame, prose
from .test_simhash import brute_components
from .test_similar import brute_set, similar


def plain_exact(rows):
    best = {}
    for r in rows:
        key = (r[1] or "").encode().lower()
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    return list(best.values())


def plain_groups(rows):
    sets = [brute_set(r[1]) for r in rows]
    return brute_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])


def tables(spark, folder, rows, labels, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_on_awkward_rows(spark, tmp_path):
    import random

    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [*documents(), (990, "x y z " + item + " q", "en", "src0", 0, 1, "u")]
    tables(spark, tmp_path, rows, [(r[0], 1, 0) for r in rows[:30] if r[0] is not None], [(1, item)])
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def written(name, df):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    kept = written("1", pipeline.quality_stage(spark, docs, folder))
    scored = {r.doc_id: r.kept for r in quality.scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in scored.items() if k}
    exact = written("2", pipeline.exact_stage(spark, kept, folder))
    assert as_tuples(exact) == sorted(plain_exact([tuple(r) for r in kept.collect()]), key=repr)
    near = written("3", pipeline.near_stage(spark, exact, folder))
    given = [tuple(r) for r in exact.collect()]
    roots = plain_groups(given)
    assert near.count() == len(set(roots)) and {tuple(r) for r in near.collect()} <= set(given)
    for group in set(roots):
        ids = [r[0] for r, root in zip(given, roots) if root == group]
        assert min((i for i in ids if i is not None), default=None) in {r.doc_id for r in near.collect()}
    clean = written("4", pipeline.decontamination_stage(spark, near, folder))
    words = [w.decode() for w in decontam.folded(item.encode()).split()]
    dirty = {r.doc_id for r in near.collect() if " ".join(words) in " ".join(w.decode() for w in decontam.folded((r.text or "").encode()).split())}
    assert 990 in dirty and {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - dirty
    packed = pipeline.packing_stage(spark, clean, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}


def test_run_equals_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").distinct().collect()
    whole = docs
    for _, apply in pipeline.STAGES[:-1]:
        whole = spark.createDataFrame(apply(spark, whole, folder).collect(), docs.schema)
        assert whole.columns == docs.columns
    ids = {r.doc_id for r in whole.collect()}
    assert 0 < len(ids) < docs.count() and {r.doc_id for r in out} == ids
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by_doc.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_stages_remove_what_earlier_ones_left(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    _store.cleanup(spark)
    lazy = pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    there = set(_store.written())
    n = pipeline.exact_stage(spark, lazy, folder).count()  # reads the first stage's blocks, which so stay
    assert n > 0 and [p for p in there if p in _store.written()]
    lazy.write.parquet(f"{tmp_path}/kept")
    there = set(_store.written())
    pipeline.exact_stage(spark, spark.read.parquet(f"{tmp_path}/kept"), folder)
    assert not there & set(_store.written())


def test_results_of_several_runs_stay_readable(spark):
    folder = "/root/testdata/sf0.001"
    _store.cleanup(spark)
    first = pipeline.run(spark, folder)
    there = set(_store.written())
    assert len(there) == 1  # the pieces that the result reads, and nothing of the stages
    wanted = as_tuples(first)
    with ThreadPoolExecutor(2) as pool:
        others = [pool.submit(pipeline.run, spark, folder), pool.submit(lambda: exact_dedup.assignments(spark.read.parquet(f"{folder}/documents.parquet")))]
        second, lazy = (o.result() for o in others)
    pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count()
    assert there <= set(_store.written())
    assert as_tuples(first) == wanted and second.count() == len(wanted)
    assert lazy.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    _store.cleanup(spark)
    assert _store.written() == []


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0
