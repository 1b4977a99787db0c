"""Keyword lists as they are shown: allowed terms from a model, its choice among candidates, and what a reader gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks, evidence, keep_ids, listed_terms, strip
from ..providers import LanguageModel
from .journal import Journal
from .keywords import is_stop

#: Candidates that a model chooses from, and terms that it is asked for.
CANDIDATES, TERMS = 120, 30
CHOOSER = {
    "cn": "你篩選章節的關鍵詞。每行是 idx、term、evidence，以 TAB 分隔。選出最重要的 {k} 個核心術語、方法或名詞；泛詞、斷裂碎片、描述動作或流程的片語、以連接詞或助詞開頭或結尾的詞都不要。只輸出一行 KEEP: i,j,k。",
    "en": "You choose the key terms of a chapter. Each line is idx, term, evidence, parted by tabs. Choose the {k} most important technical terms; leave out generic words, broken fragments, phrases that tell of actions or steps, and terms that begin or end with function words. Print one line only, KEEP: i,j,k.",
}
EXTRACTOR = {
    "cn": "從以下章節內容中選出 {k} 個最重要的詞，全部須出自文本。每行一個詞，不要編號、解釋或其他符號。",
    "en": "Name the {k} most important terms of the chapter below, all taken from its text. One term a line, without numbers, explanations or other signs.",
}


def candidates(ranked: DataFrame, pages: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(doc_id, n, lines): the best terms of each chapter as numbered lines with evidence from their best page; n: how many there are."""
    rows = ranked.where((F.col("rank") <= most) & (F.col("page_df") > 0))
    text = pages.select("doc_id", F.col("pos").alias("rep_pos"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("ocr", F.lit(""))).alias("blob"))
    seen = rows.join(text, ["doc_id", "rep_pos"], "left")
    line = F.concat((F.col("rank") - 1).cast("string"), F.lit("\t"), F.col("term"), F.lit("\t"), F.coalesce(evidence(F.col("blob"), F.col("term")), F.lit("")))
    grouped = seen.groupBy("doc_id").agg(F.max("rank").alias("n"), F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return grouped.select("doc_id", "n", F.array_join(F.transform("x", lambda i: i["line"]), "\n").alias("lines"))


def chosen_ids(listed: DataFrame, model: LanguageModel, k: int, lang: str = "en", journal: Journal | None = None) -> DataFrame:
    """(doc_id, ids): the candidates that the model keeps, numbered from 0, at most k; written, so that all that follows reads one choice."""
    journal = journal or Journal(listed.sparkSession)
    said = journal.asked(listed, F.lit(CHOOSER[lang].format(k=k)), F.concat(F.lit("chapter: "), "doc_id", F.lit("\n"), "lines"), F.lit(128), model, "said")
    return said.select("doc_id", keep_ids(F.col("said"), F.col("n"), k).alias("ids"))


def kept_and_filled(ranked: DataFrame, ids: DataFrame, topn: int) -> DataFrame:
    """The ranked rows that are kept by number, filled up to topn with the best others; chapters without ids keep all rows. Ranks are given anew."""
    rows = ranked.join(ids, "doc_id", "left")
    asked = F.coalesce(F.size("ids"), F.lit(0)) > 0
    plain = rows.where(~asked).drop("ids")
    # own rows and those that fill up stand within this many ranks, so no window sees a whole chapter
    near = rows.where(asked & (F.col("rank") <= F.greatest(F.array_max("ids") + 1, F.size("ids") + topn)))
    own = F.array_contains("ids", (F.col("rank") - 1).cast("int")) & (F.col("page_df") > 0)
    marked = near.withColumn("own", F.coalesce(own, F.lit(False)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("own"), "rank"))
    usable = marked.withColumn("place", place).where(F.col("own") | ((F.col("place") <= topn) & (F.col("page_df") > 0)))
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))
    return plain.unionByName(usable.withColumn("rank", again).drop("ids", "own", "place"))


def chapter_texts(pages: DataFrame, size: int = 3000, most: int = 6) -> DataFrame:
    """(doc_id, chunks): the first chunks of the pages of each chapter, joined in order. Only as many pages are gathered as the chunks can hold."""
    blob = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("ocr", F.lit("")))
    rows = pages.select("doc_id", "pos", blob.alias("blob")).where(strip(F.col("blob")) != "")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("blob") + 1).over(before), F.lit(0))).where(F.col("before") < size * most)
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.left("blob", F.lit(size * most)).alias("blob")))).alias("x"))
    return joined.select("doc_id", chunks(F.array_join(F.transform("x", lambda i: i["blob"]), "\n"), size, most).alias("chunks"))


def allowed_terms(pages: DataFrame, model: LanguageModel, lang: str = "en", k: int = TERMS, journal: Journal | None = None, refresh: bool = False) -> DataFrame:
    """(doc_id, terms): what the model names as terms of each chapter, without stop terms, sorted.

    Replies are kept in the journal by what was asked, which holds the chapter's text: a chapter is asked about again if
    its text, the model or the language changed, or with refresh.
    """
    journal = journal or Journal(pages.sparkSession)
    system, user = F.lit(EXTRACTOR[lang].format(k=k)), F.concat(F.lit("chapter: "), "doc_id", F.lit("\n"), F.array_join("chunks", "\n\n"))
    rows = journal.asked(chapter_texts(pages), system, user, F.lit(256), model, "said", refresh)
    every = rows.select("doc_id", F.posexplode_outer(listed_terms(F.col("said"))).alias("n", "term"))
    good = every.where(F.col("term").isNull() | ~is_stop(F.col("term")))
    first = good.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).where(F.col("at") <= k)
    return first.groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def read_allowed(text: Column) -> Column:
    """A JSON object of term lists as a map: keys that start with __, blanks and repeats are left out; null if it is none."""
    given = F.from_json(text, "map<string, string>")
    lists = F.transform_values(given, lambda k, v: F.from_json(v, "array<string>"))
    clean = F.transform_values(lists, lambda k, v: F.array_distinct(F.filter(F.transform(v, strip), lambda t: t != "")))
    named = F.transform_keys(clean, lambda k, v: strip(k))
    return F.map_filter(named, lambda k, v: (k != "") & ~F.startswith(k, F.lit("__")) & (F.coalesce(F.size(v), F.lit(0)) > 0))


def tips_empty(tips: DataFrame) -> bool:
    """Are there no keywords in any chapter?"""
    return tips.where("doc_id NOT LIKE '\\_\\_%' AND term IS NOT NULL").isEmpty()


def shown(tips: DataFrame, allowed: DataFrame, chapter: str | None = None, limit: int = 8) -> DataFrame:
    """(doc_id, n, term, fallback): the first distinct keywords of a chapter, the one asked for, else the first; allowed terms where there are none.

    tips: (doc_id, rank, term); allowed: (doc_id, terms).
    """
    if limit <= 0:
        raise ValueError("limit has to be over 0")
    own = tips.where("doc_id NOT LIKE '\\_\\_%'").select("doc_id", "rank", strip(F.col("term")).alias("term")).where("term <> ''")
    spare = allowed.select("doc_id", F.posexplode("terms").alias("rank", "term"))
    out = None
    for rows, fallback in ((own, False), (spare, True)):
        first = rows.groupBy("doc_id", "term").agg(F.min("rank").alias("rank"))
        names = first.select("doc_id").distinct()
        asked = F.lit(False) if chapter is None else F.col("doc_id") == chapter
        picked = names.orderBy(F.desc(asked), "doc_id").limit(1)
        ranked = first.join(F.broadcast(picked), "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).where(F.col("n") <= limit)  # one chapter
        part = ranked.select("doc_id", "n", "term", F.lit(fallback).alias("fallback"))
        out = part if out is None else out.unionByName(part.crossJoin(F.broadcast(out.agg(F.count(F.lit(1)).alias("n_own")))).where("n_own = 0").drop("n_own"))  # one row
    return out


def allowed_as_tips(allowed: DataFrame) -> DataFrame:
    """Allowed terms in the form of ranked keywords, without scores."""
    zero = F.lit(0.0)
    return allowed.select("doc_id", F.posexplode("terms").alias("at", "term")).select("doc_id", (F.col("at") + 1).alias("rank"), "term", zero.alias("raw_score"), zero.alias("score_norm"), F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("df"), F.lit("llm_allow_fallback").alias("source"))
