"""Operators whose results SQL cannot give, and the cases behind the queries."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import keywords, scope
from quire.providers import HashingEmbedder, embedded
from quire.sources import artifacts, pages
from quire.streaming import ingest


def test_greedy_choice_by_hand():
    rows = [("tree walk", 9.0, 3, 3, 1.0), ("tree", 8.0, 5, 4, 1.0), ("graph", 7.0, 2, 2, 0.0), ("graph search", 6.0, 2, 2, 0.5), ("sorting", 5.0, 2, 5, 1.0), ("queue", 4.0, 2, 3, 0.0), ("once", 3.0, 1, 1, 0.0)]
    # "tree" overlaps and is shorter; "graph search" replaces "graph"; the second round drops -ing words
    assert [r[0] for r in keywords.choose(rows, 5, 2, "en")] == ["tree walk", "graph search", "queue"]
    assert [r[0] for r in keywords.choose(rows, 1, 1, "en")] == ["tree walk"]


def test_stale_features_are_kept_for_compatibility():
    rows = [("alpha", 9.0, 2, 5, 1.0), ("beta", 8.0, 1, 1, 0.0)]
    assert [r[0] for r in keywords.choose(rows, 2, 1, "en")] == ["alpha"]
    assert [r[0] for r in keywords.choose(rows, 2, 1, "en", compat_stale_features=True)] == ["alpha", "beta"]


def test_canonical_rows_and_jsonl_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("", "d", None, None, "7", None, None, None, text.NO_TEXT, "", "seen", '["a.png"]', None), (None, None, "c", None, None, "x", None, None, "t", None, None, None, '{"images": ["b.png"]}')], pages.LOOSE)
    got = {r.doc_id: r for r in pages.canonical(raw).collect()}
    assert (got["d"].page, got["d"].text, got["d"].ocr, got["d"].images) == (7, None, "seen", ["a.png"])
    assert (got["c"].page, got["c"].text, got["c"].images) == (None, "t", ["b.png"])
    pages.write_jsonl(pages.canonical(raw), str(tmp_path / "out"))
    back = {r.doc_id: r.text for r in pages.read_jsonl(spark, str(tmp_path / "out"), required=True).collect()}
    assert back == {"d": text.NO_TEXT, "c": "t"}


def test_index_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([(0, "d", 1, [], "", "some text"), (1, "d", 2, [], "", "other")], "pos long, doc_id string, page int, images array<string>, ocr string, text string")
    index = rows.withColumn("embedding", embedded(F.col("text"), HashingEmbedder(16)))
    pages.write_index(index, str(tmp_path), "subject", "hashing-16")
    assert pages.read_index(spark, str(tmp_path)).count() == 2
    rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).write.mode("overwrite").parquet(f"{tmp_path}/rows")
    with pytest.raises(ValueError):
        pages.read_index(spark, str(tmp_path))


def test_selection_errors(spark):
    listed = scope.chapters(spark.createDataFrame([("CH02",), ("CH01",), ("CH01) - (CH02",)], "doc_id string"))
    assert [r.doc_id for r in listed.orderBy("ordinal").collect()] == ["CH01", "CH02"]
    for bad in (lambda: scope.by_range(listed, "3"), lambda: scope.by_range(listed, "x"), lambda: scope.by_pick(listed, "1,9"), lambda: scope.by_pick(listed, "a"), lambda: scope.by_names(listed, "CH09")):
        with pytest.raises(ValueError):
            bad()
    assert [r.doc_id for r in scope.by_names(listed, "CH02", "CH01").orderBy("selected").collect()] == ["CH01", "CH02"]


def test_stream_reads_new_files_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (1, 2):
        spark.createDataFrame([("d", n, "t", [], "")], pages.PAGE).write.mode("append").json(source)
        ingest.watch_pages(spark, source, pages.PAGE, target, mark).awaitTermination()
        assert spark.read.parquet(target).count() == n


def test_upload_status(spark):
    names, there = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.exe",)], "name string"), spark.createDataFrame([("b.pdf",)], "name string")
    assert {tuple(r) for r in ingest.upload_status(names, there, ["pdf"]).collect()} == {("a.pdf", "saved"), ("b.pdf", "overwritten"), ("c.exe", "skipped")}


def test_normal_form(spark):
    row = spark.createDataFrame([("Ｈｅｌｌｏ　 W orld ﬁ",)], "s string").select(text.normalized(F.col("s")).alias("n")).first()
    assert row.n == text.normalized_text("Ｈｅｌｌｏ　 W orld ﬁ") == "helloworldfi"


def test_exact_branch_searches_rows_without_embedding(spark, tmp_path):
    from quire.plans import registry

    docs = [(0, "plain words", "a"), (1, "the thanedble the, anea", "a"), (2, "more zzqqxx words", "b")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = lambda name: [(r.branch, r.page) for r in registry.queries()[name](spark, str(tmp_path)).orderBy("rank").collect()]
    assert hits("hybrid_search") == [(0, 1), (1, 0)]
    assert hits("search_with_fallback") == [(0, 2)]
    assert [r.pos for r in registry.search.vector_search(registry._index(spark, str(tmp_path)), [1.0, 0.0], 15, None).collect()] == [0]


def test_batch_search_finds_full_width_queries_and_variants(spark):
    from quire.operators import search

    page = spark.createDataFrame([("d", 1, 0, "", "say hello world"), ("d", 2, 1, "ＷＯＲＬＤ", "x"), ("e", None, 2, None, None)], "doc_id string, page int, pos long, ocr string, text string")
    asked = spark.createDataFrame([(1, "ｈｅｌｌｏ"), (2, "none，world"), (3, ""), (4, None), (5, "hello world，world")], "query_id int, query string")
    got = {(r.query_id, r.rank, r.doc_id, r.page, r.variant) for r in search.exact_search_batch(page, asked).collect()}
    assert got == {(1, 1, "d", 1, 0), (2, 1, "d", 1, 2), (2, 2, "d", 2, 2), (5, 1, "d", 1, 1), (5, 2, "d", 2, 2)}
    for query in ("ｈｅｌｌｏ", "none，world", "hello world，world"):
        one = [(r.rank, r.doc_id, r.page) for r in search.exact_search(search.with_blob(page), query).collect()]
        batch = search.exact_search_batch(page, asked.where(F.col("query") == query)).orderBy("rank").collect()
        assert one == [(r.rank, r.doc_id, r.page) for r in batch]
    assert search.exact_search_batch(page, asked.limit(0)).count() == 0


def test_query_variants_are_distinct_by_normal_form(spark):
    row = spark.createDataFrame([("Ａ b,ａＢ，ab;c d，CD",), ("請",), (None,)], "q string").select(text.query_variants(F.col("q")).alias("v")).collect()
    assert [r.v for r in row][:2] == [["Ａ b,ａＢ，ab;c d，CD", "Ａ b", "c d"], ["請"]]


def test_result_log_reads_what_is_printed(spark):
    hits = spark.createDataFrame([(1, 0.5, "a", 2, ["x.png"], " seen ", "one\ntwo"), (2, 0.25, "b", None, [], "", "")], "rank int, score double, doc_id string, page int, images array<string>, ocr string, text string")
    log = "noise\n" + "\n".join(r.printed for r in pages.printed(hits).orderBy("rank").collect()) + "\nafter the end"
    got = pages.result_log(spark.createDataFrame([("l", log), ("m", ""), ("n", None)], "log_id string, log string")).orderBy("record").collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, 0.5, "a", "2", ["x.png"], "seen", "one\ntwo"), (2, 2, 0.25, "b", "None", [], "", "")]
    odd = "#1 score=0.5\nTEXT:\na\ndoc_id=d page=3\nOCR:\nb\n#7 SCORE = 1.0\nimages=['q.JPG', 'r.txt']\n" + "-" * 20 + "\ndoc_id=late page=9"
    got = pages.result_log(spark.createDataFrame([("l", odd)], "log_id string, log string")).orderBy("record").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 0.5, "d", "3", [], "b", "a"), (7, 1.0, "", None, ["q.JPG"], "", "")]


def test_image_paths_of_any_shape():
    assert pages.image_paths(" a.png ", '["b.png", {"name": "n", "rel_path": "r", "images": [["c"], "a.png"]}, 3, null]') == ["a.png", "b.png", "r", "n", "c"]
    assert pages.image_paths(None, '"x"') == ["x"] and pages.image_paths("", None) == [] and pages.image_paths("{bad") == ["{bad"]


def test_choice_by_windows_of_ranks(spark, monkeypatch):
    rows = [(d, k + 1, f"term{k:04d} {d}", 100.0 - k, 2 if k > 6 else 1, 2 if k > 6 else 1, 0.0) for d in ("a", "b") for k in range(40 if d == "a" else 5)]
    given = spark.createDataFrame(rows, "doc_id string, rank int, term string, raw_score double, tf long, page_df long, heading double")
    limits = spark.createDataFrame([("a", 3, 2, 40), ("b", 3, 2, 5)], "doc_id string, eff_topn int, core_n int, n_terms long")
    whole = {tuple(r) for r in keywords.selected(given, limits).collect()}
    for ranks in (1, 3, 9):
        monkeypatch.setattr(keywords, "WINDOW_RANKS", ranks)
        assert {tuple(r) for r in keywords.selected(given, limits).collect()} == whole
    assert {r[2] for r in whole if r[0] == "a"} == {"term0007 a", "term0008 a", "term0000 a"}


def test_numbers_are_printed_as_printf_has_them(spark):
    """66.25 is a tie, and 51.65 is less than it looks."""
    values = [66.25, 66.75, 51.65, 1.00025, 0.03125, 0.0, 12345.25]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", text.fixed(F.col("x"), 1).alias("one"), text.fixed(F.col("x"), 4).alias("four")).collect()
    assert [(r.one, r.four) for r in rows] == [(f"{x:.1f}", f"{x:.4f}") for x in values]
    best = spark.createDataFrame([("c", 1, "gamibo", 66.25, 0.03125, 5, 1, 5, 7, 1)], "doc_id string, rank int, term string, score_norm double, raw_score double, tf int, df int, page_df int, rep_page int, rep_hits int")
    assert best.select(artifacts.keyword_line()).first()[0] == "1. gamibo  (norm=66.2, raw=0.0312, tf=5, df=1, page_df=5)  -> rep_page=7, hits=1"


def test_metrics_read_their_rows_once(spark):
    """The terms of all pages are counted below them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        seen.add(1)
        return x / 10

    first = F.struct(F.col("n").alias("pos"), F.lit(0).alias("place")).alias("first")
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("doc_id"), F.col("id").alias("n")).select("doc_id", score(F.col("n").cast("double")).alias("raw_score"), first)
    found = {r.doc_id: (round(r.p50, 6), r.n_terms) for r in keywords.metrics(rows).collect()}
    assert found == {"0": (1.9, 20), "1": (2.0, 20)} and seen.value == 40


def test_chinese_terms_and_scores(spark):
    blob = "樹的走 二元樹走訪方式 例如 二元樹走訪方式"
    corpus = spark.createDataFrame([("c1", 0, blob, ""), ("c1", 1, "二元樹走訪方式", ""), ("c2", 2, "圖形搜尋演算法 tree", "")], "doc_id string, pos long, text string, ocr string")
    counted = {(r.doc_id, r.pos, r.term): (r.hits, r.heading) for r in keywords.page_terms(corpus, "cn").collect()}
    assert counted == {("c1", 0, "樹的走"): (1, True), ("c1", 0, "二元樹走訪方式"): (2, True), ("c1", 1, "二元樹走訪方式"): (1, True), ("c2", 2, "圖形搜尋演算法"): (1, True)}
    kept = {r.term for r in keywords.scored(corpus, keywords.term_counts(keywords.page_terms(corpus, "cn"), "cn"), "cn").collect()}
    assert kept == {"二元樹走訪方式", "圖形搜尋演算法"}  # a particle inside a short term drops it


def test_neighbours_across_spans(spark):
    from quire.operators import browse

    rows = [("a", k if k != 4 else None, 3 * k) for k in range(9)] + [("b", 7, 5)]
    pages_ = spark.createDataFrame(rows, "doc_id string, page int, pos long")
    whole = {tuple(r) for r in browse.neighbours(pages_).collect()}
    assert whole == {tuple(r) for r in browse.neighbours(pages_, 7).collect()} == {tuple(r) for r in browse.neighbours(pages_, 1).collect()}
    assert ("a", 3, 2, None) in whole and ("a", 5, None, 6) in whole and ("a", 0, None, 1) in whole and ("b", 7, None, None) in whole and len(whole) == 10


def test_bad_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "d", "page": 1}\n\n{"doc_id": "d", "page": 2}\n')
    assert pages.checked_jsonl(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.jsonl").write_text('{"doc_id": "d"}\n\nno json\n{bad\n')
    with pytest.raises(ValueError, match="b.jsonl, line 3 is no JSON: no json"):
        pages.checked_jsonl(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no rows"):
        pages.checked_jsonl(spark, str(tmp_path / "c"))


def test_titles_and_sections_are_searched(spark):
    from quire.operators import search

    rows = spark.createDataFrame([("d", 1, 0, "On Trees", "Part Two", None, "x"), ("d", 2, 1, None, None, None, "part two")], "doc_id string, page int, pos long, title string, section string, ocr string, text string")
    asked = spark.createDataFrame([(1, "trees"), (2, "part two")], "query_id long, query string")
    assert {(r.query_id, r.page) for r in search.exact_search_batch(rows, asked).collect()} == {(1, 1), (2, 1), (2, 2)}
    assert [r.page for r in search.exact_search(search.with_blob(rows), "trees").collect()] == [1]


def test_bad_lines_of_a_file_of_many_ranges(spark, tmp_path):
    rows = ['{"doc_id": "%d", "text": "%s"}' % (k, "x" * (k % 37)) if k % 50 else ("no json %d" % k if k % 100 else "  ") for k in range(1, 2001)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("\n\n{}\noops", encoding="utf-8")
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, v in zip(held, ("4096", "512"), strict=True):
            spark.conf.set(c, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted(tuple(r) for r in pages.bad_lines(spark, str(tmp_path)).collect())
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert got == [("a.jsonl", k, f"no json {k}") for k in range(50, 2001, 100)] + [("b.jsonl", 4, "oops")]


def test_ranks_and_percentiles_are_counted_over_ranges(spark):
    from quire.operators import numbering

    rng = random.Random(6)
    rows = [("hot" if k % 3 else f"d{k % 7}", rng.choice([rng.random(), 0.25, 0.5]), k) for k in range(900)] + [("one", 2.0, 1000), ("same", 1.0, 1001), ("same", 1.0, 1002)]
    given = spark.createDataFrame(rows, "doc_id string, raw_score double, id long").repartition(5)
    want = {}
    for d, raw, k in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        want[k] = sum(1 for r in rows if r[0] == d and (-r[1], r[2]) <= (-raw, k))
    got = numbering.running(given, "doc_id", [F.desc("raw_score"), F.col("id")], ranges=6)
    assert {r.id: r["rank"] for r in got.collect()} == want and got.columns == [*given.columns, "rank"]
    values = given.groupBy("doc_id", "raw_score").agg(F.count(F.lit(1)).alias("n"))
    exact = {r.doc_id: r.p for r in given.groupBy("doc_id").agg(F.percentile("raw_score", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    assert {r.doc_id: r.p for r in keywords.percentiles(values, "raw_score", (0.1, 0.5, 0.9)).collect()} == exact
    assert keywords.percentiles(values.limit(0), "raw_score", (0.5,)).count() == 0


@pytest.mark.parametrize("stale", [False, True])
def test_a_choice_that_is_taken_up_again_is_the_plain_one(spark, monkeypatch, stale):
    rng = random.Random(9)
    words = ["tree", "trees", "node", "nod", "graph theory", "graph", "a b", "sort", "sorted", "binary tree", "heap", "-", "walk"]
    rows, want = [], {}
    for d in range(12):
        n = rng.choice([1, 3, 9, 30])
        own = [(rng.choice(words) + rng.choice(["", " x", " yz"]) * (d % 3), 50.0 - k // 2, rng.randint(1, 3), rng.randint(0, 4), rng.choice([0.0, 0.5, 1.0])) for k in range(n)]
        rows += [(f"d{d}", k + 1, *r) for k, r in enumerate(own)]
        want[f"d{d}"] = [r[:4] for r in keywords.choose(own, 1 + d % 5, 1 + d % 3 if d % 5 > 1 else 1, "en", stale)]
    given = spark.createDataFrame(rows, "doc_id string, rank int, term string, raw_score double, tf long, page_df long, heading double")
    sizes = {d: sum(r[0] == d for r in rows) for d in want}
    limits = spark.createDataFrame([(d, 1 + int(d[1:]) % 5, 1 + int(d[1:]) % 3 if int(d[1:]) % 5 > 1 else 1, sizes[d]) for d in want], "doc_id string, eff_topn int, core_n int, n_terms long")
    for window in (1, 4, 1000) if not stale else (3,):
        monkeypatch.setattr(keywords, "WINDOW_RANKS", window)
        got = {d: [] for d in want}
        for r in sorted(keywords.selected(given, limits, "en", stale).collect(), key=lambda r: (r.doc_id, r["rank"])):
            got[r.doc_id].append(tuple(r)[2:])
        assert got == want, window


def test_topics_look_at_the_beginning_of_a_text(spark):
    """A first line may be a whole text: no pattern goes over all of it, and short, blank, chapter and numbered ones are told apart."""
    from quire.operators import exam

    long = "a longer, first line of words " * 2000
    texts = [None, "  \n ", "ab c\nshort, with a second line", "a b\nsecond line, of the page", "CH12 　title of the chapter, a page", "CH12\ntitle of the chapter, a page", f"  {long}", f" 3-1 the {long}", "這頁是沒有txt的", f"這頁是沒有txt的{' ' * 60}x"]
    found = exam.topics(spark.createDataFrame(list(enumerate(texts)), "pos long, text string"))
    assert [(r.pos, r.topic) for r in found.collect()] == [
        (2, "ab c short, with a second line"), (5, "CH12 title of the chapter, a page"), (6, long[:60].strip()), (7, f"3-1 the {long}".strip()),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace(coalesce(text" not in plan


def test_texts_are_composed_in_bounded_batches(spark):
    import unicodedata

    import pyarrow as pa

    texts = ["ＡＢ ﬁ", None, "plain", "", "é", *["x"] * 70, "①", None]
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert all(text.composed(pa.array(texts), n).to_pylist() == want for n in (1, 3, 64)) and text.composed(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(text.nfkc(F.col("t"))).collect()] == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20
