"""Counts of terms that tasks combine before they leave them."""

import random

import pytest

from quire.operators import counts, keywords
from quire.sources import scratch

PAGES = "doc_id string, pos long, text string, ocr string"


@pytest.mark.parametrize("lang", ["en", "cn"])
@pytest.mark.parametrize("at_once", [1 << 20, 300])
def test_counted_is_term_counts(spark, monkeypatch, lang, at_once):
    """Whatever the slices, positions (equal, negative, beyond 32 bits, none) and characters are."""
    monkeypatch.setattr(keywords, "FOUND_AT_ONCE", at_once)
    monkeypatch.setattr(keywords, "CHARS_AT_ONCE", at_once)
    rng = random.Random(5)
    words = "binary tree node Graph Search heap Binary Tree Walk visits the with AI NASA ABCDEFGHIJ İstanbul Straße café x_y a1 2nd naïve Éa ＡＢ 二元樹 資料結構 aaaaaaaaaa".split()
    text = lambda: "".join(rng.choice(words) + rng.choice(["  ", " ", "\n", ", ", "-", "_", "'", "̇"]) for _ in range(rng.randint(0, 30)))
    places = [0, 1, 5, 5, 2**31, 2**32 - 1, 2**32, 2**62, -1, -7, 2**63 - 1, -(2**63) + 1, None]
    rows = [(rng.choice(["a", "b", "", None]), rng.choice([rng.choice(places), rng.randint(0, 10**6)]), rng.choice([None, text(), text()]), rng.choice([None, "", text()])) for _ in range(400)]
    pages = spark.createDataFrame(rows, PAGES)
    told = lambda df: sorted((str(r.asDict(True)) for r in df.collect()))
    expected = told(keywords.term_counts(keywords.page_terms(pages, lang), lang))
    assert expected and told(keywords.counted(pages, lang)) == expected
    assert keywords.counted(pages.limit(0), lang).count() == 0


def test_rows_do_not_grow_with_pages(spark, monkeypatch):
    """What leaves a task is a row per chapter and term, not per page and term."""
    rows = [(f"c{k % 2}", k, "binary tree visits every node", "") for k in range(2000)]
    whole = {(r.doc_id, r.term): (r.tf, r.page_df, r.rep_pos) for r in keywords.counted(spark.createDataFrame(rows, PAGES)).collect()}
    assert whole["c1", "tree"] == (1000, 1000, 1) and len(whole) == 10
    monkeypatch.setattr(keywords, "_summed", lambda parts, lang: parts)
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert keywords.counted(spark.createDataFrame(rows, PAGES)).count() <= (n_tasks + 1) * 5


def test_added_counts_are_written_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "new_path", lambda *_: pytest.fail("written to a scratch folder first"))
    found = counts.TermCounts(spark, str(tmp_path / "counts"))
    found.add(spark.createDataFrame([("a", 1, "binary tree", ""), ("b", 2, "tree heap", "")], PAGES))
    found.remove(spark.createDataFrame([("a",)], "doc_id string"))
    assert {r.term: r.df for r in found.document_frequency().collect()} == {"tree": 1, "heap": 1}
