"""Stored indexes against scans of all rows, positions, and the journal of replies."""

import random
import re
import shutil
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import answers, cells, grams, journal, listing, numbering, scope, search, stored
from quire.providers import HashingEmbedder, embedded

SCHEMA = "doc_id string, page int, pos long, text string, ocr string"


def blob(r):
    return "".join(unicodedata.normalize("NFKC", "\n".join([r[0] or "", r[4] or "", r[3] or ""])).lower().split())


def pages(rng, n=300):
    words = "tree node graph 圖 樹狀 é a ab abc ＡＢ x\x00y , the the the".split(" ")
    rows = [(f"d{rng.randint(0, 9)}", rng.randint(1, 40), k * 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice(["", None, "seen"])) for k in range(n)]
    return rows + [("d1", None, 10_001, None, None), ("", 1, 10_002, "", ""), ("d2", 7, 10_003, "ends with zq", None), ("d2", 7, 10_004, "ends with zq", None)]


def plain_exact(rows, query, k):
    forms = search.driver_variants(query)
    best = {}
    for r in rows:
        hit = next((n for n, v in enumerate(forms) if v in blob(r)), None)
        if hit is not None and ((r[0], r[1]) not in best or (hit, r[2]) < best[r[0], r[1]][:2]):
            best[r[0], r[1]] = (hit, r[2], r)
    top = sorted(best.values(), key=lambda x: x[:2])[:k]
    return [(n + 1, 1.0, *x[2]) for n, x in enumerate(top)]


@pytest.fixture(scope="module")
def gram_index(spark, tmp_path_factory):
    rows = pages(random.Random(4))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path_factory.mktemp("grams"))
    grams.build(search.with_blob(frame), path)
    return rows, grams.GramIndex(spark, path)


QUERIES = ["tree", "node graph", "圖", "樹狀圖", "ab", "x", "Q", "zq", "q", "tree node, graph 圖 ; ab", "nothing here", "", " ", "a", "x\x00y", "y\x00", "the the the the", "seen", "ｄ1", "nodetree；zz；seen", "d2"]


@pytest.mark.parametrize("window", [2, 64])
def test_gram_search_is_a_scan(gram_index, monkeypatch, window):
    rows, index = gram_index
    monkeypatch.setattr(grams, "WINDOW", window)
    for query in QUERIES:
        for k in (1, 15) if window > 2 else (15,):
            got = [(r.rank, r.score, r.doc_id, r.page, r.pos, r.text, r.ocr) for r in index.exact_search(query, k).collect()]
            assert got == plain_exact(rows, query, k), (query, k)


def test_gram_search_reads_its_postings_only(gram_index):
    _, index = gram_index
    plan = index.candidates(["樹狀圖"])._jdf.queryExecution().explainString(index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "pages" not in re.findall(r"Location: .*", plan)[0] and re.search(r"PartitionFilters: \[.*folder", plan) and re.search(r"PushedFilters: \[.*(In|EqualTo)\(gram", plan)
    prefix = index.candidates(["q"])._jdf.queryExecution().explainString(index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(gram,q)" in prefix
    for g in ("樹狀圖", "abc", "x\x00y", "\x00\x00\x00"):
        assert index.spark.createDataFrame([(g,)], "gram string").select(grams._folder()).first()[0] == grams._folder_of(g)


def vectors(spark, rng, n=900, dim=8):
    centres = rng.normal(size=(6, dim)) * 4
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + rng.normal(size=dim) * (0.1 if k % 9 else 2))]) for k in range(n)]
    rows += [(n + 1, None), (n + 2, [0.0] * dim), (n + 3, rows[5][1]), (n + 4, rows[5][1])]
    return rows, spark.createDataFrame(rows, "pos long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("least", [None, 0.5, 1e9])
def test_cell_search_is_a_scan(spark, tmp_path, least):
    rng = np.random.default_rng(3)
    rows, frame = vectors(spark, rng)
    cells.build(frame, str(tmp_path), 25)
    index = cells.CellIndex(spark, str(tmp_path))
    queries = [(k, [float(x) for x in rows[k][1]]) for k in (0, 5, 17, 300)] + [(901, [0.0] * 8), (902, [float(-x) for x in rows[3][1]])]
    for _, q in queries:
        want = [(r.pos, r.score) for r in search.vector_search(frame, q, 7, least).collect()]
        assert [(r.pos, r.score) for r in index.search(q, 7, least).collect()] == want
    stated = spark.createDataFrame([*queries, (999, None)], "query_id int, vector array<double>")
    want = sorted((r.query_id, r["rank"], r.pos, round(r.score, 6)) for r in search.vector_search_batch(frame.where("embedding IS NOT NULL"), stated.where("vector IS NOT NULL"), 7, least).collect())
    assert sorted((r.query_id, r["rank"], r.pos, round(r.score, 6)) for r in index.search_batch(stated, 7, least).collect()) == want
    assert least == 1e9 or len(want) > 7


def test_cells_are_skipped_and_tasks_pass_on_k_rows(spark, tmp_path):
    rows, frame = vectors(spark, np.random.default_rng(5), 3000)
    cells.build(frame, str(tmp_path), 40)
    index = cells.CellIndex(spark, str(tmp_path))
    q = [float(x) for x in rows[1][1]]
    near = index.search(q, 5, None)
    filters = re.search(r"PartitionFilters: \[.*?cell#\d+ IN \(([^)]*)\)", near._jdf.queryExecution().toString().replace("\n", " ")) or re.search(r"cell#\d+ IN \(([^)]*)\)", near._jdf.queryExecution().toString())
    assert filters and len(filters[1].split(",")) < 30
    given = (np.array([q]), np.array([np.linalg.norm(q) + cells.SLACK]), np.array([q]) @ index.centres.T, index.cells, [1])
    from pyspark.sql.types import IntegerType

    found = index.rows.select("cell", "far", "pos", "embedding").mapInArrow(cells._matcher(*given, IntegerType(), 5, np.array([-np.inf])), "query_id int, pos long, score double")
    assert found.withColumn("task", F.spark_partition_id()).groupBy("task").count().agg(F.max("count")).first()[0] <= 5


def test_empty_indexes(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA + ", embedding array<float>")
    stored.build(search.with_blob(none), str(tmp_path))
    index = stored.StoredIndex(spark, str(tmp_path))
    assert index.exact_search("tree").count() == index.hybrid_search("tree", [1.0]).count() == index.search("q", [1.0]).count() == 0
    assert index.cells.search_batch(spark.createDataFrame([(1, [1.0])], "query_id int, vector array<double>")).count() == 0


def test_stored_searches_are_those_of_frames(spark, tmp_path):
    rows = pages(random.Random(8), 120)
    frame = search.with_blob(spark.createDataFrame(rows, SCHEMA)).withColumn("embedding", embedded(F.col("text"), HashingEmbedder(16)))
    stored.build(frame, str(tmp_path))
    index, vector = stored.StoredIndex(spark, str(tmp_path)), [float(x) for x in HashingEmbedder(16).encode(["tree node graph"])[0]]
    same = lambda df: [(r["rank"], r.branch, round(r.score, 9), r.doc_id, r.page) for r in df.collect()]
    for query in ("tree", "zq", "nothing"):
        assert same(index.hybrid_search(query, vector, 8, 0.1)) == same(search.hybrid_search(frame, query, vector, 8, 0.1))
        assert same(index.search(query, vector, 8, 0.1)) == same(search.search(frame, query, vector, 8, 0.1))


@pytest.mark.parametrize("ranges", [1, 5])
def test_numbers_are_gapless(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randint(0, 4)) for _ in range(500)] + [(None, 1)] * 3
    out = numbering.numbered(spark.createDataFrame(rows, "a string, b int").repartition(7), [F.col("a"), F.col("b").desc()], ranges=ranges).orderBy("position").collect()
    assert [r.position for r in out] == list(range(503))
    assert [(r.a, r.b) for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert numbering.numbered(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


def test_a_gram_search_brings_hits_alone_to_the_driver(spark, tmp_path, monkeypatch):
    """All pages have the grams of the query, the last few hold it."""
    rows = [("d", n, n, f"abcx xbcd {'abcd' if n > 4990 else ''}", None) for n in range(5000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    grams.build(search.with_blob(frame), str(tmp_path))
    index, collect, sizes, texts = grams.GramIndex(spark, str(tmp_path)), type(frame).collect, [], []

    def seen(df):
        out = collect(df)
        sizes.append(len(out))
        texts.append(len(out) if "text" in df.columns else 0)
        return out

    monkeypatch.setattr(type(frame), "collect", seen)
    found = index.exact_search("abcd", 15)
    monkeypatch.undo()
    assert [r.pos for r in found.collect()] == list(range(4991, 5000))
    assert max(sizes) <= 1000 and sum(texts) <= 15


def test_a_pick_is_searched_in_its_order(spark, tmp_path):
    rows = [(f"CH0{c}", p, c * 1000 + p, f"page {p} of the common word", None) for c in range(1, 6) for p in range(1, 4)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    chosen = scope.by_pick(scope.chapters(frame), "3,1,5")
    merged = scope.placed(scope.merged(frame, chosen))
    assert [(r.doc_id, r.page) for r in merged.orderBy("pos").collect()] == [(f"CH0{c}", p) for c in (3, 1, 5) for p in (1, 2, 3)]
    assert sorted(r.pos for r in merged.collect()) == list(range(9))
    grams.build(search.with_blob(merged), str(tmp_path))
    assert [(r.doc_id, r.page) for r in grams.GramIndex(spark, str(tmp_path)).exact_search("common word", 4).collect()] == [("CH03", 1), ("CH03", 2), ("CH03", 3), ("CH01", 1)]


class Restless:
    """Never says the same twice, and writes down what it is asked."""

    def __init__(self, folder, fails=False):
        self.folder, self.model, self.fails = str(folder), "restless", fails

    def complete(self, system, user, max_tokens):
        import os
        import uuid

        name = uuid.uuid4().hex
        with open(os.path.join(self.folder, name), "w") as f:
            f.write(user)
        if self.fails:
            raise OSError("no service")
        bits = int(name[0], 16)
        return f"A usable answer, number {name}." if bits % 2 else ("short" if bits % 4 else f"sources: {name}")


def test_every_question_is_answered_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [("CH01", p, p, f"topic {p} of the course, told in some words", None) for p in range(1, 21)]
    index = search.with_blob(spark.createDataFrame(rows, SCHEMA)).withColumn("embedding", embedded(F.col("text"), HashingEmbedder(32)))
    asked = spark.createDataFrame([(p, f"topic {p} of") for p in range(1, 21)] + [(99, "zzz"), (98, None)], "query_id long, question string")
    held = journal.Journal(spark, str(tmp_path / "journal"))
    ask = lambda: answers.answered(index, asked, Restless(calls), None, 5, journal=held)
    out = ask()
    first = sorted((tuple(r) for r in out.collect()), key=repr)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == first  # read again: the same
    assert sorted(r[0] for r in first) == sorted([*range(1, 21), 99, 98]) and {r[3] for r in first} <= {"answer", "summary", "template", "none"}
    n = len(list(calls.iterdir()))
    assert 20 <= n <= 40 and n == held.replies().count()
    assert sorted((tuple(r) for r in ask().collect()), key=repr) == first and len(list(calls.iterdir())) == n  # nothing is asked again


def test_failed_calls_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, q string")
    held = journal.Journal(spark, str(tmp_path / "journal"))
    told = lambda model, **x: {r.k: r.reply for r in held.asked(rows, F.lit("s"), F.col("q"), F.lit(5), model, **x).collect()}
    calls = tmp_path / "calls"
    calls.mkdir()
    assert told(Restless(calls, True)) == {1: "", 2: "", 3: ""} and len(list(calls.iterdir())) == 2
    said = told(Restless(calls))
    assert said[1] == said[3] and len(list(calls.iterdir())) == 4
    assert told(Restless(calls)) == said and len(list(calls.iterdir())) == 4
    assert told(Restless(calls), refresh=True) != said and len(list(calls.iterdir())) == 6


def test_allowed_terms_are_kept_by_content(spark, tmp_path):
    class Namer:
        model = "namer"

        def __init__(self, folder):
            self.folder = folder

        def complete(self, system, user, max_tokens):
            import os
            import uuid

            open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
            return "queue\nstack"

    calls = tmp_path / "calls"
    calls.mkdir()
    held = journal.Journal(spark, str(tmp_path / "journal"))
    rows = [("CH01", 1, 1, "a queue", ""), ("CH02", 1, 2, "a stack", "")]
    terms = lambda rows, **x: listing.allowed_terms(spark.createDataFrame(rows, SCHEMA), Namer(str(calls)), journal=held, **x).collect()
    n = lambda: len(list(calls.iterdir()))
    assert {r.doc_id: r.terms for r in terms(rows)} == {"CH01": ["queue", "stack"], "CH02": ["queue", "stack"]} and n() == 2
    assert len(terms(rows)) == 2 and n() == 2
    assert len(terms([rows[0], ("CH02", 1, 2, "another stack", "")])) == 2 and n() == 3
    assert len(terms(rows, refresh=True)) == 2 and n() == 5


def test_counts_are_kept_up_to_date(spark, tmp_path):
    from quire.operators import counts, keywords

    rng = random.Random(12)
    words = "binary tree node Graph Search queue heap sorting Binary Tree Walk visits every node the with".split()
    rows = [(f"c{k % 4}", k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), rng.choice(["", None, "seen Heap Sort"])) for k in range(40)] + [("c4", 50, "", None), (None, 51, "tree", "")]
    whole = spark.createDataFrame(rows, "doc_id string, pos long, text string, ocr string")

    def full(pages):
        pages = pages.where("doc_id IS NOT NULL")
        return sorted(tuple(r) for r in keywords.scored(pages, keywords.term_counts(keywords.page_terms(pages))).select("doc_id", "term", "tf", "page_df", "df", "first", "rep_pos", "raw_score").collect())

    def held():
        return sorted(tuple(r) for r in found.scored().select("doc_id", "term", "tf", "page_df", "df", "first", "rep_pos", "raw_score").collect())

    found = counts.TermCounts(spark, str(tmp_path / "counts"))
    assert held() == [] and found.keywords().count() == 0
    old = str(tmp_path / "old")
    whole.where("doc_id <> 'c1' OR doc_id IS NULL").write.parquet(old)
    found.add(spark.read.parquet(old))
    shutil.rmtree(old)  # pages that were counted are not read again
    found.add(whole.where("doc_id = 'c1'").withColumn("text", F.lit("other words here")))
    found.add(whole.where("doc_id = 'c1'"))
    assert held() == full(whole)
    assert {tuple(r) for r in found.keywords(3).collect()} == {tuple(r) for r in keywords.keywords(whole.where("doc_id IS NOT NULL"), 3).collect()}
    found.remove(spark.createDataFrame([("c2",), ("none",)], "doc_id string"))
    rest = whole.where("doc_id <> 'c2'")
    assert held() == full(rest)
    assert {r.term: r.df for r in found.document_frequency().collect()} == {r.term: r.df for r in keywords.document_frequency(keywords.term_counts(keywords.page_terms(rest))).collect()}
    # what is written but not listed does not count
    listed = found._table("list", counts._LIST).count()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spark, "createDataFrame", None)
        with pytest.raises(TypeError):
            found.add(whole.where("doc_id = 'c2'"))
    assert found._table("list", counts._LIST).count() == listed and held() == full(rest)
    found.compact()
    for name in ("counts", "chapters", "changes"):
        folders = sorted((tmp_path / "counts" / "en" / name).glob("batch=*"), key=lambda f: f.stat().st_mtime)
        for folder in folders[:-1]:
            shutil.rmtree(folder)  # nothing before a whole batch is read
    assert held() == full(rest)
