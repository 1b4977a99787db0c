"""Exact, vector and hybrid search, and the contexts packed from their hits.

A set of queries is stated and bounded (it is broadcast up to a counted bound,
and read in blocks beyond it); pages are scanned once per block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import fixed, normalized, normalized_text, snippet, squeeze, strip

#: Queries that go to the executors at once.
QUERY_BLOCK = 10_000
MIN_SIMILARITY = 0.60


#: What of a page is searched, as far as it has these columns.
SEARCHED = ("doc_id", "title", "section", "ocr", "text")


def _searched(pages: DataFrame) -> list[str]:
    return [c for c in SEARCHED if c in pages.columns]


def with_blob(pages: DataFrame, compose: bool = True) -> DataFrame:
    """Adds blob, the normal form that is searched; keep it with the index."""
    return pages.withColumn("blob", normalized(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _searched(pages))), compose))


def driver_variants(query: str) -> list[str]:
    """Normal forms of a query's variants, in order."""
    import re

    from ..functions.text import QUERY_FILLERS

    cleaned = query or ""
    for w in QUERY_FILLERS:
        cleaned = cleaned.replace(w, " ")
    forms = (normalized_text(v) for v in [query or "", *re.split(r"[，,。；;：:\n\r\t]+", cleaned)])
    return list(dict.fromkeys(f for f in forms if f))


def exact_search(pages: DataFrame, query: str, k: int = 15) -> DataFrame:
    """The first k pages whose blob contains a variant of the query, by variant and position; one hit per (doc_id, page)."""
    variants = driver_variants(query)
    if not variants:
        return pages.limit(0).select(F.lit(0).alias("rank"), F.lit(1.0).alias("score"), "doc_id", "page", "pos", "text", "ocr")
    at = F.coalesce(*(F.when(F.contains("blob", F.lit(v)), n) for n, v in enumerate(variants)))
    hits = pages.withColumn("variant", at).where("variant IS NOT NULL")
    best = hits.groupBy("doc_id", "page").agg(F.min_by(F.struct("variant", "pos", "text", "ocr"), F.struct("variant", "pos")).alias("h"))
    top = best.select("doc_id", "page", "h.*").orderBy("variant", "pos").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("variant", "pos"))).select("rank", F.lit(1.0).alias("score"), "doc_id", "page", "pos", "text", "ocr")


def exact_search_batch(pages: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, rank, doc_id, page, variant) for a stated set of queries (query_id, query).

    The variants of a block of queries make one automaton, so a page's blob is normalised and read once, whatever
    their number; a page gives each query that hits it one row, with its first variant.
    """
    out = None
    for block in query_blocks(queries.select("query_id", "query"), "query_id"):
        stated = block.collect()  # at most QUERY_BLOCK
        kind = block.schema["query_id"].dataType
        fields = f"query_id {kind.simpleString()}, doc_id string, page int, pos long, variant int"
        hits = pages.select(F.col("doc_id").cast("string"), F.col("page").cast("int"), F.col("pos").cast("long"), *(F.col(c).cast("string") for c in _searched(pages) if c != "doc_id")).mapInArrow(_matcher([(r.query_id, driver_variants(r.query)) for r in stated], to_arrow_type(kind)), fields)
        out = hits if out is None else out.unionByName(hits)
    best = out.groupBy("query_id", "doc_id", "page").agg(F.min(F.struct("variant", "pos")).alias("h")).select("query_id", "doc_id", "page", "h.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("variant", "pos")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "page", "variant")


def _matcher(stated: list[tuple], kind: pa.DataType):
    """Hits of pages (doc_id, page, pos, and what else is searched) for queries (id, variants)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        uses: dict[str, list[tuple[int, int]]] = {}
        for at, (_, variants) in enumerate(stated):
            for n, v in enumerate(variants):
                uses.setdefault(v, []).append((at, n))
        machine = ahocorasick.Automaton()
        for v in uses:
            machine.add_word(v, v)
        if uses:
            machine.make_automaton()
        ids = pa.array([i for i, _ in stated], kind)
        for batch in batches:
            rows, query, variant = [], [], []
            for at, (doc_id, _, _, *texts) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                blob = normalized_text("\n".join(t or "" for t in (doc_id, *texts)))
                first: dict[int, int] = {}
                for v in {v for _, v in machine.iter(blob)} if uses else ():
                    for q, n in uses[v]:
                        first[q] = min(n, first.get(q, n))
                rows += [at] * len(first)
                query += first
                variant += first.values()
            found = batch.select(["doc_id", "page", "pos"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query, pa.int64())), *found.columns, pa.array(variant, pa.int32())], names=["query_id", "doc_id", "page", "pos", "variant"])

    return run


def query_blocks(stated: DataFrame, key: str) -> list[DataFrame]:
    """The queries in blocks of a bounded size, by a hash of their key."""
    n = stated.count()
    parts = max(1, -(-2 * n // QUERY_BLOCK)) if n > QUERY_BLOCK else 1
    return [stated] if parts == 1 else [stated.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def mean_pooled(rows: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """(key, i, value): the mean of the vectors of each key, by place; with a mask, of those that it weighs."""
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    flat = rows.select(key, weight.alias("_w"), F.posexplode(vector).alias("i", "x"))
    return flat.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-9))).alias("value"))


def vector_search(index: DataFrame, query: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
    """The k rows of the index with the largest inner products, of those that reach min_similarity; rows without an embedding are left out."""
    score = dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)))
    rows = index.where("embedding IS NOT NULL").withColumn("score", score)
    if min_similarity is not None:
        rows = rows.where(F.col("score") >= min_similarity)
    return rows.orderBy(F.desc("score"), "pos").limit(k)


def vector_search_batch(index: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
    """(query_id, rank, pos, score) for a stated set of queries (query_id, vector)."""
    out = None
    for block in query_blocks(queries.select("query_id", "vector"), "query_id"):
        hits = index.select("pos", "embedding").crossJoin(F.broadcast(block)).select("query_id", "pos", dot(F.col("embedding"), F.col("vector")).alias("score"))
        hits = hits if min_similarity is None else hits.where(F.col("score") >= min_similarity)
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def merged_hits(exact: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Exact hits before vector hits, the first of each (doc_id, page), at most k. Both have rank, score, doc_id, page."""
    both = exact.select(F.lit(0).alias("branch"), "rank", "score", "doc_id", "page").unionByName(vector.select(F.lit(1).alias("branch"), "rank", "score", "doc_id", "page"))
    first = both.groupBy("doc_id", "page").agg(F.min(F.struct("branch", "rank", "score")).alias("h")).select("doc_id", "page", "h.branch", F.col("h.rank").alias("at"), "h.score")
    top = first.orderBy("branch", "at").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("branch", "at"))).select("rank", "branch", "score", "doc_id", "page")


def ranked_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pos")))


def hybrid_search(index: DataFrame, query: str, vector: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
    """index: doc_id, page, pos, text, ocr, blob, embedding."""
    return merged_hits(exact_search(index, query, k), ranked_hits(vector_search(index, vector, k, min_similarity)), k)


def search(index: DataFrame, query: str, vector: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
    """Exact hits if there are any, else vector hits."""
    exact = exact_search(index, query, k)
    near = ranked_hits(vector_search(index, vector, k, min_similarity))
    found = exact.agg(F.count(F.lit(1)).alias("n_exact"))
    near = near.crossJoin(F.broadcast(found)).where("n_exact = 0")  # one row
    return merged_hits(exact, near, k)


def _cite(separator: str = "/") -> Column:
    return F.when(F.col("page").isNull(), F.col("doc_id")).otherwise(F.concat(F.col("doc_id"), F.lit(f"{separator}p"), F.col("page").cast("string")))


def _blob() -> Column:
    return strip(squeeze(F.concat(F.coalesce("ocr", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))))


def packed_context(hits: DataFrame, max_chars: int = 9000, per_hit: int = 700) -> DataFrame:
    """(query_id, context, cites): hits in order of rank, cut to per_hit characters, until the first that would pass max_chars; blank hits have no number."""
    rows = hits.withColumn("blob", _blob()).where("blob <> ''")
    by = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("cite", _cite())
    piece = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("cite"), F.lit(" score="), fixed(F.col("score"), 4), F.lit("\n"), F.left("blob", F.lit(per_hit)), F.lit("\n"))
    rows = rows.withColumn("piece", piece).withColumn("used", F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where(F.col("used") <= max_chars)
    grouped = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "cite"))).alias("p"))
    return grouped.select("query_id", strip(F.array_join(F.transform("p", lambda x: x["piece"]), "\n")).alias("context"), F.transform("p", lambda x: x["cite"]).alias("cites"))


def packed_exam_context(hits: DataFrame, max_chars: int = 6000, per_hit: int = 1200) -> DataFrame:
    """(query_id, context, sources): numbered by rank, blanks included; the sources also hold the hit that did not fit any more."""
    by = Window.partitionBy("query_id").orderBy("rank")
    doc = F.when(F.coalesce(strip(F.col("doc_id")), F.lit("")).isin("", "none", "None"), "unknown").otherwise(strip(F.col("doc_id")))
    short = F.left(squeeze(strip(F.concat(F.coalesce("ocr", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))), F.lit(per_hit))
    rows = hits.withColumn("n", F.row_number().over(by)).withColumn("snippet", short)
    piece = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), doc, F.lit("/p"), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(" score="), fixed(F.col("score"), 4), F.lit("\n"), F.col("snippet"), F.lit("\n"))
    rows = rows.withColumn("piece", piece).withColumn("used", F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("used").over(by), F.lit(0))).where(F.col("before") <= max_chars)
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("used") <= max_chars, F.col("piece")).alias("piece"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("tag")))).alias("p"))
    fits = F.filter(F.transform("p", lambda x: x["piece"]), lambda x: x.isNotNull())
    return grouped.select("query_id", strip(F.array_join(fits, "\n")).alias("context"), F.transform("p", lambda x: x["tag"]).alias("sources"))


def fallback_answer(hits: DataFrame, items: int = 3, per_hit: int = 220) -> DataFrame:
    """(query_id, answer): the best snippets, for when no answer could be made."""
    rows = hits.where(F.col("rank") <= items).withColumn("blob", _blob()).where("blob <> ''")
    entry = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), _cite(" / "), F.lit(" (score="), fixed(F.col("score"), 4), F.lit(")\n"), snippet(F.col("blob"), per_hit), F.lit("\n"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("p"))
    sources = F.array_join(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ", ")
    return grouped.select("query_id", F.concat(F.array_join(F.transform("p", lambda x: x["entry"]), "\n"), F.lit("\nSOURCES: "), sources).alias("answer"))
