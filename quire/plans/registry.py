"""One query per operator over the synthetic tables, with the equivalent DuckDB SQL where SQL can express it.

Chapters are sources and pages are documents: doc_id := source, page := pos :=
documents.doc_id. Names and numerals come from literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import browse, cells, counts, exam, grams, keywords, scope, search, stored
from ..sources import artifacts
from ..sources import pages as sources
from ..sources.scratch import new_path
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page"), F.col("doc_id").alias("pos"), "text", F.lit("").alias("ocr"))


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def norm_sql(x: str) -> str:
    return rf"regexp_replace(lower({x}), '\s+', '', 'g')"


CORPUS = "corpus AS (SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS page, doc_id AS pos, text, '' AS ocr FROM documents)"
BLOBS = f"{CORPUS}, blobs AS MATERIALIZED (SELECT doc_id, page, pos, {norm_sql('doc_id || ocr || text')} AS blob FROM corpus)"
PARTS = r"[，,。；;：:\n\r\t]+"
VARIANTS = f"""raw AS (SELECT item_id, unnest(list_concat([text], string_split_regex(text, '{PARTS}'))) AS v, generate_subscripts(list_concat([text], string_split_regex(text, '{PARTS}')), 1) AS n FROM benchmark),
  forms AS (SELECT item_id, {strip_sql('v')} AS v, n, {norm_sql('v')} AS form FROM raw),
  firsts AS (SELECT item_id, form, min(n) AS n, arg_min(v, n) AS v FROM forms WHERE form <> '' GROUP BY item_id, form),
  variants AS MATERIALIZED (SELECT item_id, form, v, row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS variant FROM firsts)"""

#: A query whose parts occur in some pages each.
TEXT_QUERY = "the and attion, thanedble"
TEXT_FORMS = search.driver_variants(TEXT_QUERY)
EXACT_CASE = "CASE " + " ".join(f"WHEN contains(blob, '{v}') THEN {k}" for k, v in enumerate(TEXT_FORMS)) + " END"


# Search

_stored: dict[tuple[str, str], stored.StoredIndex | cells.CellIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> stored.StoredIndex:
    """The search index of the documents of a folder, built once a session, as a library does for a scope."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = new_path(spark, "index")
        stored.build(_index(spark, sf_dir), path)
        _stored[key] = stored.StoredIndex(spark, path)
    return _stored[key]


@query(f"""WITH {BLOBS}, hits AS (SELECT *, {EXACT_CASE} AS variant FROM blobs)
  SELECT CAST(row_number() OVER (ORDER BY variant, pos) AS INTEGER) AS rank, CAST(1.0 AS DOUBLE) AS score, doc_id, page, pos FROM hits WHERE variant IS NOT NULL ORDER BY variant, pos LIMIT 15""")
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).exact_search(TEXT_QUERY).select("rank", "score", "doc_id", "page", "pos")


SHORT_QUERY = "，Zé。q"
SHORT_CASE = "CASE " + " ".join(f"WHEN contains(blob, '{v}') THEN {k}" for k, v in enumerate(search.driver_variants(SHORT_QUERY))) + " END"


@query(f"""WITH {BLOBS}, hits AS (SELECT *, {SHORT_CASE} AS variant FROM blobs)
  SELECT CAST(row_number() OVER (ORDER BY variant, pos) AS INTEGER) AS rank, CAST(1.0 AS DOUBLE) AS score, doc_id, page, pos FROM hits WHERE variant IS NOT NULL ORDER BY variant, pos LIMIT 15""")
def exact_search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).exact_search(SHORT_QUERY).select("rank", "score", "doc_id", "page", "pos")


@query(f"""WITH {BLOBS}, {VARIANTS}, hits AS (SELECT item_id AS query_id, doc_id, page, pos, min(variant) AS variant FROM blobs JOIN variants ON contains(blob, form) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, pos) AS rank FROM hits)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, page, CAST(variant AS INTEGER) AS variant FROM ranked WHERE rank <= 15""")
def exact_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.exact_search_batch(corpus(spark, sf_dir), stated)


@query(f"WITH {VARIANTS} SELECT item_id, string_agg(v, '|' ORDER BY variant) AS variants FROM variants GROUP BY item_id")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_variants(F.col("text")), "|").alias("variants"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


def vector_index(spark: SparkSession, sf_dir: str) -> cells.CellIndex:
    """The cells of all embeddings, built once a session."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/embeddings")
    if key not in _stored:
        path = new_path(spark, "cells")
        cells.build(_vectors(spark, sf_dir), path)
        _stored[key] = cells.CellIndex(spark, path)
    return _stored[key]


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).where("pos = 0").first().embedding)


DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS pos, round({DOT}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {DOT} >= 0.1 ORDER BY {DOT} DESC, a.vec_id LIMIT 15")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index(spark, sf_dir).search(_first_vector(spark, sf_dir), 15, 0.1).select("pos", F.round("score", 6).alias("score"))


@query(f"""WITH hits AS (SELECT b.vec_id AS query_id, a.vec_id AS pos, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM hits WHERE score >= 0.1)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _vectors(spark, sf_dir).where("pos % 50 = 0").select(F.col("pos").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index(spark, sf_dir).search_batch(stated, 10, 0.1).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


@query(f"""WITH hits AS (SELECT b.vec_id AS query_id, a.vec_id AS pos, {DOT} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM hits)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, pos, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = _vectors(spark, sf_dir).where("pos % 50 = 0").select(F.col("pos").alias("query_id"), F.col("embedding").alias("vector"))
    return vector_index(spark, sf_dir).search_batch(stated, 5, None).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = search.l2_normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH flat AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT label, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM flat GROUP BY label, i""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their embedding or null."""
    return search.with_blob(corpus(spark, sf_dir)).join(_vectors(spark, sf_dir), "pos", "left")


def _hybrid_sql(case: str, fallback: bool) -> str:
    only = "WHERE NOT EXISTS (SELECT 1 FROM exact)" if fallback else ""
    return f"""WITH {BLOBS}, idx AS (SELECT blobs.*, embedding FROM blobs LEFT JOIN embeddings ON vec_id = pos),
  exact AS (SELECT 0 AS branch, row_number() OVER (ORDER BY variant, pos) AS loc, CAST(1.0 AS DOUBLE) AS score, doc_id, page FROM (SELECT *, {case} AS variant FROM idx) WHERE variant IS NOT NULL ORDER BY variant, pos LIMIT 15),
  near AS (SELECT 1 AS branch, row_number() OVER (ORDER BY score DESC, pos) AS loc, score, doc_id, page FROM (SELECT a.*, {DOT} AS score FROM idx a, embeddings b WHERE b.vec_id = 0) WHERE score >= 0.1 ORDER BY score DESC, pos LIMIT 15),
  both_ AS (SELECT * FROM exact UNION ALL SELECT * FROM near {only}),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY branch, loc) AS k FROM both_)
  SELECT CAST(row_number() OVER (ORDER BY branch, loc) AS INTEGER) AS rank, branch, round(score, 6) AS score, doc_id, page FROM firsts WHERE k = 1 ORDER BY branch, loc LIMIT 15"""


RARE_QUERY = "thanedble the, anea"
RARE_CASE = "CASE " + " ".join(f"WHEN contains(blob, '{v}') THEN {k}" for k, v in enumerate(search.driver_variants(RARE_QUERY))) + " END"


@query(_hybrid_sql(RARE_CASE, False))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).hybrid_search(RARE_QUERY, _first_vector(spark, sf_dir), 15, 0.1).withColumn("score", F.round("score", 6))


@query(_hybrid_sql("CASE WHEN contains(blob, 'zzqqxx') THEN 0 END", True))
def search_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).search("zzqqxx", _first_vector(spark, sf_dir), 15, 0.1).withColumn("score", F.round("score", 6))


@query(_hybrid_sql(RARE_CASE, True))
def search_with_exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_index(spark, sf_dir).search(RARE_QUERY, _first_vector(spark, sf_dir), 15, 0.1).withColumn("score", F.round("score", 6))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.lit(1.0).alias("score"), F.col("role").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text", F.lit("").alias("ocr"))


BLANKLESS = strip_sql(squeeze_sql("text"))


@query(f"""WITH rows_ AS (SELECT conv_id, turn, role, {BLANKLESS} AS blob FROM conversations), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM rows_ WHERE blob <> ''),
  pieces AS (SELECT *, '[' || n || '] ' || role || '/p' || turn || ' score=1.0000' || chr(10) || left(blob, 300) || chr(10) AS piece FROM numbered),
  sums AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY n) AS used FROM pieces)
  SELECT conv_id AS query_id, {strip_sql("string_agg(piece, chr(10) ORDER BY n)")} AS context, string_agg(role || '/p' || turn, ',' ORDER BY n) AS cites FROM sums WHERE used <= 900 GROUP BY conv_id""")
def pack_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.packed_context(_hits(spark, sf_dir), 900, 300).withColumn("cites", F.array_join("cites", ","))


@query(f"""WITH numbered AS (SELECT *, {squeeze_sql(strip_sql('text'))} AS blob, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
  pieces AS (SELECT *, '[' || n || '] ' || role || '/p' || turn || ' score=1.0000' || chr(10) || left(blob, 300) || chr(10) AS piece FROM numbered),
  sums AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY n) AS used FROM pieces), before_ AS (SELECT *, coalesce(lag(used) OVER (PARTITION BY conv_id ORDER BY n), 0) AS before FROM sums)
  SELECT conv_id AS query_id, {strip_sql("coalesce(string_agg(piece, chr(10) ORDER BY n) FILTER (WHERE used <= 900), '')")} AS context, string_agg('[' || n || ']', ',' ORDER BY n) AS sources FROM before_ WHERE before <= 900 GROUP BY conv_id""")
def pack_context_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.packed_exam_context(_hits(spark, sf_dir), 900, 300).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH rows_ AS (SELECT conv_id, turn, role, {BLANKLESS} AS blob FROM conversations WHERE turn <= 3), kept AS (SELECT *, CASE WHEN length(blob) > 220 THEN rtrim(left(blob, 220)) || '...' ELSE rtrim(blob) END AS short FROM rows_ WHERE blob <> ''),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM kept)
  SELECT conv_id AS query_id, string_agg('[' || turn || '] ' || role || ' / p' || turn || ' (score=1.0000)' || chr(10) || short || chr(10), chr(10) ORDER BY turn) || chr(10) || 'SOURCES: ' || string_agg('[' || n || ']', ', ' ORDER BY n) AS answer FROM numbered GROUP BY conv_id""")
def fallback_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fallback_answer(_hits(spark, sf_dir))


# Text


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("digest"))


def _noise_sql(s: str) -> str:
    dense = f"replace({s}, ' ', '')"
    return rf"""(CASE WHEN {s} = '' OR regexp_matches({s}, '[\x{{4e00}}-\x{{9fff}}]') THEN false
      WHEN regexp_matches({s}, '^\d+[-_]{{2,}}\d+$') OR regexp_matches({s}, '^(?:\d+-\d+\s*)+$') OR regexp_matches({s}, '(R\d){{3,}}') THEN true
      WHEN length({s}) < 10 THEN false
      WHEN regexp_matches({s}, '^[A-Za-z0-9\-\s]+$') AND len(list_distinct(string_split({dense}, ''))) / greatest(1, length({dense})) < 0.35 THEN true
      ELSE length({s}) - length(replace({s}, '-', '')) >= 3 END)"""


@query(f"""WITH lines AS (SELECT doc_id, {strip_sql("unnest(string_split(text, chr(10)))")} AS s FROM documents)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_noise_sql('s')}) AS n_noise FROM lines GROUP BY doc_id""")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_noise(F.col("line"))).alias("n_noise"))


SHAPES_SQL = " OR ".join(f"regexp_matches(s, '{p}')" for p in text.NOISE_LINES)


@query(rf"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  spaced AS (SELECT doc_id, n, {strip_sql(r"regexp_replace(line, '\s{2,}', ' ', 'g')")} AS line FROM raw),
  cut AS (SELECT doc_id, n, regexp_replace(regexp_replace(line, '(R\d){{3,}}[\w\-]*', '', 'g'), '\b\d{{3}}[-_]{{3}}\d{{3}}\b', '', 'g') AS line FROM spaced), marked AS (SELECT *, {strip_sql('line')} AS s FROM cut),
  kept AS (SELECT * FROM marked WHERE NOT (s = '' OR {_noise_sql('s')} OR {SHAPES_SQL}) AND NOT regexp_matches(line, '^\d+$') AND line <> '')
  SELECT d.doc_id, md5(coalesce({strip_sql("string_agg(line, chr(10) ORDER BY n)")}, '')) AS digest FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cleaned_text(F.col("text"))).alias("digest"))


def rows(spark: SparkSession, values: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


#: What a query takes from the tables besides its stated rows: a table and expressions that both engines know.
FROM_TABLES = {
    "q": ("conversations", "text"),
    "raw": ("conversations", "concat('say {\"conv\": ', CAST(conv_id AS VARCHAR(20)), ', \"turn\": ', CAST(turn AS VARCHAR(20)), '} KEEP: ', CAST(turn AS VARCHAR(20)), ', ', CAST(conv_id % 17 AS VARCHAR(20)), ' ', role)"),
    "id, s": ("documents", "doc_id + 1000", "concat('第', source, '樹狀結構', lang, '的搜尋', CAST(doc_id AS VARCHAR(20)))"),
    "id, text, ocr": ("documents", "doc_id + 1000", "text", "source"),
    "t": ("pages", "url"),
    "doc, page, img, w, h, page_w, page_h": ("documents", "source", "doc_id", "CAST(doc_id % 3 AS INT)", "CAST(n_chars % 300 AS INT)", "CAST(n_chars % 199 AS INT)", "200", "210"),
}


def given(spark: SparkSession, sf_dir: str, values: str, columns: str) -> DataFrame:
    """Stated rows, and those of a table."""
    name, *parts = FROM_TABLES[columns]
    more = table(spark, sf_dir, name).select(*(F.expr(p).alias(c) for p, c in zip(parts, columns.split(", "), strict=True)))
    return rows(spark, values, columns).union(more)


def given_sql(values: str, columns: str) -> str:
    name, *parts = FROM_TABLES[columns]
    return f"(SELECT * FROM (VALUES {values}) AS v UNION ALL SELECT {', '.join(parts)} FROM {name}) AS t({columns})"


TEXT_ROWS = "(1, 'a text', 'an ocr'), (2, '', 'only ocr'), (3, 'only text', ''), (4, '這頁是沒有txt的', 'behind the mark'), (5, '', '')"


@query(f"SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN text NOT IN ('', '這頁是沒有txt的') THEN text END, nullif(ocr, '')) AS body FROM {given_sql(TEXT_ROWS, 'id, text, ocr')}")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, TEXT_ROWS, "id, text, ocr").select("id", text.index_text(F.col("text"), F.col("ocr")).alias("body"))


QUESTIONS = "('請說明流程'), ('比較兩者的差異'), ('整理重點'), ('列出步驟並比較'), ('什麼是圖'), ('what is the process'), ('')"
TASK_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{name}'" for name, words in text.TASK_WORDS.items()) + " ELSE 'qa' END"


@query(f"""WITH t AS (SELECT q, {TASK_SQL} AS task FROM {given_sql(QUESTIONS, 'q')})
  SELECT q, task, CASE task WHEN 'process' THEN 768 WHEN 'qa' THEN 384 ELSE 640 END AS tokens, CASE task WHEN 'process' THEN 30 WHEN 'qa' THEN 15 ELSE 25 END AS depth FROM t""")
def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = text.task_type(F.col("q"))
    return given(spark, sf_dir, QUESTIONS, "q").select("q", task.alias("task"), text.answer_tokens(task).alias("tokens"), text.search_depth(task, F.lit(40)).alias("depth"))


def _replace_sql(x: str, words: list[str]) -> str:
    for w in words:
        x = f"replace({x}, '{w}', ' ')"
    return x


@query(f"SELECT q, coalesce(nullif({strip_sql(squeeze_sql(_replace_sql('q', text.TOPIC_FILLERS)))}, ''), nullif(q, '')) AS topic FROM {given_sql(QUESTIONS, 'q')}")
def main_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, QUESTIONS, "q").select("q", text.main_topic(F.col("q")).alias("topic"))


@query(f"SELECT conv_id, turn, {strip_sql('text')} <> '' AND NOT starts_with(lower({strip_sql('text')}), 'sources:') AND length({strip_sql('text')}) >= 10 AS usable FROM conversations")
def usable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.usable_answer(F.col("text")).alias("usable"))


@query(f"""WITH b AS (SELECT doc_id, {squeeze_sql(strip_sql('text'))} AS blob FROM documents), p AS (SELECT *, instr(blob, 'thanedble') AS loc FROM b)
  SELECT doc_id, CASE WHEN loc > 0 THEN substr(blob, greatest(loc - 61, 0) + 1, least(length(blob), loc + 59) - greatest(loc - 61, 0)) ELSE left(blob, 120) END AS snippet FROM p""")
def evidence_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.evidence(F.col("text"), F.lit("thanedble")).alias("snippet"))


@query("""WITH c AS (SELECT doc_id, list_transform(range(CAST(ceil(length(text) / 700.0) AS BIGINT)), lambda i: substr(text, i * 700 + 1, 700)) AS parts FROM documents)
  SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, md5(array_to_string(parts, '|')) AS digest FROM c""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.chunks(F.col("text"), 700, 1 << 30)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM pages")
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.sanitized(F.col("url")).alias("name"))


JSON_ROWS = """('no json'), ('x {"a": 1} y'), ('{"a": {"b": 2}} tail'), ('{bad}'), ('pre {"a": "}"} post')"""


@query(f"SELECT raw, CASE WHEN json_valid(regexp_extract(raw, '(?s)\\{{.*\\}}', 0)) THEN regexp_extract(raw, '(?s)\\{{.*\\}}', 0) END AS found FROM {given_sql(JSON_ROWS, 'raw')}")
def parse_first_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, JSON_ROWS, "raw").select("raw", text.first_json(F.col("raw")).alias("found"))


KEEP_ROWS = "('KEEP: 3, 1, 3, 99, 2'), ('keep : 7'), ('none'), ('KEEP: 0, 5, 5, 4, 8, 9, 10'), ('KEEP: 2, 11, 12 and 4')"


@query(f"""WITH n AS (SELECT raw, list_filter(list_transform(regexp_extract_all(regexp_extract(raw, '(?i)KEEP\\s*:\\s*([0-9,\\s]+)', 1), '\\d+'), lambda x: CAST(x AS INTEGER)), lambda x: x < 12) AS l FROM {given_sql(KEEP_ROWS, 'raw')})
  SELECT raw, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:4], ',') AS ids FROM n""")
def parse_keep_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, KEEP_ROWS, "raw").select("raw", F.array_join(text.keep_ids(F.col("raw"), 12, 4).cast("array<string>"), ",").alias("ids"))


# Keywords


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"
JUNK_SQL = r"(length(term) <= 2 OR (length(replace(term, ' ', '')) >= 8 AND len(list_distinct(string_split(replace(term, ' ', ''), ''))) / length(replace(term, ' ', '')) < 0.35) OR (length(term) <= 4 AND regexp_matches(term, '(ing|ed|tion|ness|ment)$')))"
STOPS = _in(keywords.STOP_EN + keywords.STOP_TERMS + keywords.FORMAT_NOISE)
TERMS = rf"""src AS (SELECT source AS doc_id, doc_id AS pos, {ASCII} AS t, lower(left(text, 80)) AS head FROM documents),
  lists AS (SELECT doc_id, pos, head, list_concat(list_concat(regexp_extract_all(t, '{keywords.EN_PASSES[0]}'), regexp_extract_all(t, '{keywords.EN_PASSES[1]}')), regexp_extract_all(lower(t), '{keywords.EN_PASSES[2]}')) AS l FROM src),
  flat AS (SELECT doc_id, pos, head, lower({squeeze_sql('unnest(l)')}) AS term, generate_subscripts(l, 1) AS place FROM lists),
  kept AS (SELECT * FROM flat WHERE term NOT IN {STOPS} AND NOT regexp_matches(term, '{keywords.ROMAN_WORD}') AND NOT {JUNK_SQL}),
  hits AS (SELECT doc_id, pos, term, count(*) AS hits, min(place) AS place, max(CASE WHEN contains(head, term) THEN 1 ELSE 0 END) AS heading FROM kept GROUP BY ALL),
  counts AS MATERIALIZED (SELECT doc_id, term, CAST(sum(hits) AS BIGINT) AS tf, count(*) AS page_df, least(1.0, sum(heading) * 0.5) AS heading, min(pos) AS first_pos, arg_min(place, pos) AS first_place, arg_max(pos, hits * 1000000000000 - pos) AS rep_pos, max(hits) AS rep_hits FROM hits GROUP BY doc_id, term)"""
SCORES = f"""{TERMS}, dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term), sizes AS (SELECT source AS doc_id, count(*) AS pages_in_doc FROM documents GROUP BY source),
  scored AS MATERIALIZED (SELECT c.*, df, page_df / pages_in_doc AS coverage, (0.55 * ln((n - df + 0.5) / (df + 0.5) + 1.0) + 0.35 * (page_df / pages_in_doc) + 0.10 * heading) * (tf / (tf + 3.0)) * pow(greatest(1e-6, 1.0 - df / n), 1.5) * CASE WHEN length(c.term) >= 7 THEN 0.5 ELSE 1.0 END AS raw
    FROM counts c JOIN dfs USING (term) JOIN sizes USING (doc_id), (SELECT count(*) AS n FROM sizes)),
  ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, first_pos, first_place) AS rank FROM scored WHERE raw > 0)"""
METRICS = f"""{SCORES}, spread AS (SELECT doc_id, quantile_cont(raw, 0.1) AS p10, quantile_cont(raw, 0.5) AS p50, quantile_cont(raw, 0.9) AS p90, avg(raw) AS mean, avg(raw) FILTER (WHERE rank <= 100) AS head, count(*) AS n_terms FROM ranked GROUP BY doc_id)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.counted(corpus(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.scored(corpus(spark, sf_dir), _counts(spark, sf_dir))


@query(f"WITH {TERMS} SELECT doc_id, term, tf, page_df FROM counts")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("doc_id", "term", "tf", "page_df")


OTHERS = "(SELECT * FROM documents WHERE source <> (SELECT max(source) FROM documents))"


@query(f"WITH {SCORES.replace('FROM documents', f'FROM {OTHERS}')} SELECT doc_id, term, df, round(coverage, 6) AS coverage, round(heading, 6) AS heading, round(raw, 6) AS raw_score FROM scored WHERE raw > 0")
def updated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all chapters but one, which is added, first by its heads alone; then another one is removed."""
    pages, found = corpus(spark, sf_dir), counts.TermCounts(spark, new_path(spark, "counts"))
    ends = pages.agg(F.min("doc_id").alias("late"), F.max("doc_id").alias("gone"))  # one row
    marked = pages.crossJoin(F.broadcast(ends))
    late = marked.where("doc_id = late").drop("late", "gone")
    found.add(marked.where("doc_id <> late").drop("late", "gone"))
    found.add(late.withColumn("text", F.left("text", F.lit(40))))
    found.add(late)
    found.remove(ends.select(F.col("gone").alias("doc_id")))
    return found.scored().select("doc_id", "term", "df", *(F.round(c, 6).alias(c) for c in ("coverage", "heading", "raw_score")))


@query(f"WITH {TERMS} SELECT term, count(*) AS df FROM counts GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.document_frequency(_counts(spark, sf_dir))


@query(f"WITH {TERMS} SELECT doc_id, term, rep_pos, rep_hits FROM counts")
def representative_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("doc_id", "term", "rep_pos", "rep_hits")


@query(f"WITH {SCORES} SELECT doc_id, term, df, round(coverage, 6) AS coverage, round(heading, 6) AS heading, round(raw, 6) AS raw_score FROM scored WHERE raw > 0")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "term", "df", *(F.round(c, 6).alias(c) for c in ("coverage", "heading", "raw_score")))


@query(f"WITH {SCORES} SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(raw, 6) AS raw_score, round(100.0 * raw / max(raw) OVER (PARTITION BY doc_id), 4) AS score_norm FROM ranked WHERE rank <= 10")
def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = keywords.ranked(_scored(spark, sf_dir), 10)
    return keywords.with_norm(best).select("doc_id", "rank", "term", F.round("raw_score", 6).alias("raw_score"), F.round("score_norm", 4).alias("score_norm"))


@query(f"""WITH {METRICS} SELECT doc_id, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(coalesce(p90 / nullif(p50, 0), 0), 6) AS sep_p90_p50, round(coalesce(head / nullif(mean, 0), 0), 6) AS head_over_all, round(coalesce(p10 / nullif(p90, 0), 0), 6) AS tail_p10_over_p90, n_terms FROM spread""")
def score_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keywords.metrics(_scored(spark, sf_dir))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in out.columns[1:-1]), "n_terms")


@query(f"""WITH {METRICS}, seps AS (SELECT doc_id, n_terms, coalesce(p90 / nullif(p50, 0), 0) AS sep FROM spread), lims AS (SELECT doc_id, sep, CASE WHEN n_terms <= 6 THEN 5 ELSE 10 END AS few FROM seps),
  effs AS (SELECT doc_id, CASE WHEN sep > 0 AND sep < 1.10 THEN least(few, 3) WHEN sep > 0 AND sep < 1.25 THEN least(few, 5) ELSE few END AS eff_topn FROM lims) SELECT doc_id, eff_topn, least(4, eff_topn) AS core_n FROM effs""")
def adaptive_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.adaptive_limits(keywords.metrics(_scored(spark, sf_dir)), 10).select("doc_id", "eff_topn", "core_n")


PROMOTED = f"""{SCORES}, phrases AS (SELECT doc_id, word, arg_min(term, rank) AS phrase, arg_min(page_df, rank) AS page_df, arg_min(heading, rank) AS heading FROM (SELECT doc_id, unnest(list_distinct(string_split(term, ' '))) AS word, term, rank, page_df, heading FROM ranked WHERE rank <= 200 AND contains(term, ' ')) WHERE length(word) > 2 GROUP BY doc_id, word),
  taken AS (SELECT r.doc_id, CASE WHEN p.phrase IS NOT NULL AND (p.page_df >= r.page_df OR p.heading > r.heading OR p.heading >= 0.5) THEN p.phrase ELSE r.term END AS term, r.rank FROM ranked r LEFT JOIN phrases p ON p.doc_id = r.doc_id AND p.word = r.term AND NOT contains(r.term, ' '))"""


@query(f"WITH {PROMOTED} SELECT doc_id, term, CAST(min(rank) AS INTEGER) AS place FROM taken GROUP BY doc_id, term")
def phrase_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.promoted(_scored(spark, sf_dir)).select("doc_id", "term", "place")


KEY_SQL = f"translate(lower(replace(term, ' ', '')), '{keywords.KEY_MARKS}{keywords.KEY_PARTICLES}', '')"
FIT_SQL = "(page_df > 0 AND NOT (NOT contains(term, ' ') AND length(term) <= 4 AND heading < 0.5 AND page_df < 4))"
FILLER_SQL = f"({FIT_SQL} AND (contains(term, ' ') OR NOT (heading < 1.0 AND page_df <= 2 OR regexp_matches(term, '(ed|ing)$'))))"
# one row more: to the end of the list, into the place of what it overlaps, or nowhere
STEP_SQL = """CASE WHEN p IS NULL THEN list_append(places, item) WHEN (length(item.term), item.raw) > (length(places[p].term), places[p].raw) THEN list_concat(list_append(places[:p - 1], item), places[p + 1:]) ELSE places END"""


def _round_sql(name: str, start: str, listed: str, most: str) -> str:
    return f"""{name} AS (SELECT doc_id, 0 AS n, {most} AS most, places FROM {start} UNION ALL
    SELECT doc_id, n, most, {STEP_SQL} AS places FROM (SELECT s.doc_id, c.n, s.most, s.places, c.item, list_position(list_transform(s.places, lambda x: contains(x.key, c.item.key) OR contains(c.item.key, x.key)), true) AS p
      FROM {name} s JOIN {listed} c ON c.doc_id = s.doc_id AND c.n = s.n + 1 WHERE len(s.places) < s.most))"""


ITEM_SQL = "struct_pack(key := key, term := term, raw := raw, tf := tf, page_df := page_df)"
GREEDY_SQL = f"""WITH RECURSIVE {PROMOTED}, again AS MATERIALIZED (SELECT r.*, {KEY_SQL} AS key FROM ranked r SEMI JOIN taken t ON t.doc_id = r.doc_id AND t.term = r.term),
  spread AS (SELECT doc_id, quantile_cont(raw, 0.5) AS p50, quantile_cont(raw, 0.9) AS p90, count(*) AS n_terms FROM again GROUP BY doc_id),
  lims AS (SELECT doc_id, coalesce(p90 / nullif(p50, 0), 0) AS sep, CASE WHEN n_terms <= 6 THEN 5 ELSE 10 END AS few FROM spread),
  effs AS MATERIALIZED (SELECT doc_id, CASE WHEN sep > 0 AND sep < 1.10 THEN least(few, 3) WHEN sep > 0 AND sep < 1.25 THEN least(few, 5) ELSE few END AS eff FROM lims),
  cores AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS n, {ITEM_SQL} AS item FROM again WHERE {FIT_SQL} AND greatest(page_df, tf) >= 2),
  fillers AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS n, {ITEM_SQL} AS item FROM again WHERE {FILLER_SQL}),
  none AS (SELECT doc_id, eff, CAST([] AS STRUCT(key VARCHAR, term VARCHAR, raw DOUBLE, tf BIGINT, page_df BIGINT)[]) AS places FROM effs),
  {_round_sql("core", "none", "cores", "least(4, eff)")},
  begun AS MATERIALIZED (SELECT c.doc_id, any_value(eff) AS eff, arg_max(c.places, c.n) AS places FROM core c JOIN effs USING (doc_id) GROUP BY c.doc_id),
  {_round_sql("filled", "begun", "fillers", "eff")},
  final AS (SELECT doc_id, arg_max(places, n) AS places FROM filled GROUP BY doc_id)
  SELECT doc_id, CAST(n AS INTEGER) AS rank, places[n].term AS term, round(places[n].raw, 6) AS raw_score, places[n].tf AS tf, places[n].page_df AS page_df FROM (SELECT doc_id, places, unnest(range(1, len(places) + 1)) AS n FROM final)"""


@query(GREEDY_SQL)
def greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keywords(corpus(spark, sf_dir)).withColumn("raw_score", F.round("raw_score", 6))


@query(f"""WITH {SCORES}, best AS (SELECT *, 100.0 * raw / max(raw) OVER (PARTITION BY doc_id) AS norm FROM ranked WHERE rank <= 10)
  SELECT doc_id, CAST(rank AS INTEGER) AS rank, printf('%d. %s  (norm=%.1f, raw=%.4f, tf=%d, df=%d, page_df=%d)  -> rep_page=%d, hits=%d', rank, term, norm, raw, tf, df, page_df, rep_pos, rep_hits) AS line FROM best""")
def tips_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = keywords.with_norm(keywords.ranked(_scored(spark, sf_dir), 10))
    return best.withColumn("rep_page", F.col("rep_pos")).select("doc_id", "rank", artifacts.keyword_line().alias("line"))


CN_ROWS = "(1, '二元樹的走訪方式與圖形演算法 tree 走訪'), (2, '例如 其中'), (3, '資料結構資料結構資料結構資料'), (4, 'abc')"


@query(f"WITH f AS (SELECT id, unnest(regexp_extract_all(s, '[\\x{{4e00}}-\\x{{9fff}}]{{2,8}}')) AS term FROM {given_sql(CN_ROWS, 'id, s')}) SELECT id, term FROM f WHERE term NOT IN {_in(keywords.STOP_CN)}")
def extract_terms_cn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, CN_ROWS, "id, s").select("id", F.explode(keywords.terms(F.col("s"), "cn")).alias("term")).where(~F.col("term").isin(keywords.STOP_CN))


JUNK_ROWS = "('二元樹'), ('若是這樣'), ('aaaaaaaaab'), ('ab'), ('a/b/c'), ('running'), ('ring'), ('1234'), ('其他樹'), ('大約三個節點數'), ('深度優先走訪'), ('步驟'), ('SKIP it'), ('能力')"
SHAPE_SQL = " OR ".join(f"(regexp_matches(t, '{p}')" + (f" AND length(t) <= {n})" if n else ")") for p, n in keywords.JUNK_SHAPES if p != r"^[\d\W_]+$")


@query(
    f"SELECT t, (length(t) <= 2 OR {' OR '.join(f'''contains(t, '{b}')''' for b in keywords.BOILERPLATE)} OR regexp_matches(t, '^[0-9_]+$') OR (length(t) >= 8 AND len(list_distinct(string_split(t, ''))) / length(t) < 0.35) OR {SHAPE_SQL}) AS junk FROM {given_sql(JUNK_ROWS, 't')}"
)
def junk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, JUNK_ROWS, "t").select("t", keywords.is_junk(F.col("t")).alias("junk"))


# Chapters

CHAPTERS = "chapters AS (SELECT CAST(row_number() OVER (ORDER BY CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER), source) AS INTEGER) AS ordinal, source AS doc_id FROM (SELECT DISTINCT source FROM documents))"


@query(f"WITH {CHAPTERS} SELECT ordinal, doc_id FROM chapters")
def chapter_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.chapters(corpus(spark, sf_dir))


@query(f"WITH {CHAPTERS} SELECT ordinal, doc_id, ordinal - 1 AS selected FROM chapters WHERE ordinal BETWEEN 2 AND 5")
def select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.by_range(scope.chapters(corpus(spark, sf_dir)), "5-2")


@query(f"WITH {CHAPTERS} SELECT ordinal, doc_id, CASE ordinal WHEN 7 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS selected FROM chapters WHERE ordinal IN (7, 2, 4)")
def select_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.by_pick(scope.chapters(corpus(spark, sf_dir)), "7, 2, 7, 4")


@query(f"WITH {CHAPTERS}, {CORPUS} SELECT ordinal - 1 AS selected, pos, doc_id, page FROM chapters JOIN corpus USING (doc_id) WHERE ordinal BETWEEN 2 AND 5")
def merge_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus(spark, sf_dir)
    return scope.merged(pages, scope.choose(scope.chapters(pages), span="2-5")).select("selected", "pos", "doc_id", "page")


@query(f"""WITH {CHAPTERS}, {CORPUS}, picked AS (SELECT doc_id, page, text, pos, CASE ordinal WHEN 3 THEN 1 ELSE 2 END AS selected FROM chapters JOIN corpus USING (doc_id) WHERE ordinal IN (3, 1)),
  placed AS (SELECT *, row_number() OVER (ORDER BY selected, pos) - 1 AS place, {norm_sql('doc_id || text')} AS blob FROM picked), hits AS (SELECT *, {EXACT_CASE} AS variant FROM placed)
  SELECT CAST(row_number() OVER (ORDER BY variant, place) AS INTEGER) AS rank, doc_id, page, place AS pos FROM hits WHERE variant IS NOT NULL ORDER BY variant, place LIMIT 40""")
def merged_scope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search over a scope that is picked as 3, 1: the pages of chapter 3 come before those of chapter 1."""
    pages = corpus(spark, sf_dir)
    path = new_path(spark, "scope")
    grams.build(search.with_blob(scope.placed(scope.merged(pages, scope.by_pick(scope.chapters(pages), "3,1")))), path)
    return grams.GramIndex(spark, path).exact_search(TEXT_QUERY, 40).select("rank", "doc_id", "page", "pos")


STEMS = "('CH04'), ('CH04_x'), ('(II) a'), ('(iv) z'), ('第三章'), ('第十二章 x'), ('第2節'), ('Chapter 3'), ('Unit-7 b'), ('Lecture 2'), ('notes_2'), ('alpha'), ('beta10'), ('beta9'), ('CH12 sorting')"
ROMANS = "('I'), ('iv'), ('IX'), ('XIV'), ('MCMXC'), ('abc'), ('')"
CN_NUMBERS = "('一'), ('十'), ('十二'), ('二十'), ('三十五'), ('兩'), ('零'), ('42'), ('百'), ('x')"
CN_DIGIT_SQL = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.CN_DIGITS.items()) + " END"


def _cn_sql(s: str) -> str:
    tens = f"CASE WHEN instr({s}, '十') > 1 THEN {CN_DIGIT_SQL.format(f'substr({s}, instr({s}, {chr(39)}十{chr(39)}) - 1, 1)')} ELSE 1 END"
    last = f"coalesce({CN_DIGIT_SQL.format(f'right({s}, 1)')}, 0)"
    return f"CASE WHEN regexp_matches({s}, '^\\d+$') THEN TRY_CAST({s} AS INTEGER) WHEN regexp_matches({s}, '^[零一二兩三四五六七八九十]+$') THEN CASE WHEN contains({s}, '十') THEN ({tens}) * 10 ELSE 0 END + {last} END"


def _roman_sql(source: str) -> str:
    """(s, n) of each s of a relation."""
    value = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in names.ROMAN_DIGITS.items()) + " END"
    return f"""SELECT s, CAST(sum(CASE WHEN v < coalesce(later, 0) THEN -v ELSE v END) AS INTEGER) AS n FROM (SELECT s, i, v, max(v) OVER (PARTITION BY s ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
      FROM (SELECT s, i, {value} AS v FROM (SELECT s, unnest(string_split(upper(s), '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM ({source}) WHERE regexp_matches(upper(s), '^[IVXLCDM]+$')))) GROUP BY s"""


@query(f"WITH v AS (SELECT s FROM (VALUES {ROMANS}) AS t(s)), r AS ({_roman_sql('SELECT s FROM v')}) SELECT s, n FROM v LEFT JOIN r USING (s)")
def roman_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, ROMANS, "s").select("s", names.roman_to_int(F.col("s")).alias("n"))


@query(f"SELECT s, {_cn_sql('s')} AS n FROM (VALUES {CN_NUMBERS}) AS t(s)")
def cn_num_to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, CN_NUMBERS, "s").select("s", names.cn_to_int(F.col("s")).alias("n"))


HINTS = f"""stems AS (SELECT stem, regexp_extract(stem, '{names.EN_CHAPTER}', 1) AS en, regexp_extract(stem, '{names.CN_CHAPTER}', 1) AS cn, regexp_extract(stem, '{names.ROMAN_CHAPTER}', 1) AS s, regexp_extract(stem, '{names.TRAILING_NUMBER}', 1) AS tail FROM (VALUES {STEMS}) AS t(stem)),
  romans AS ({_roman_sql("SELECT DISTINCT s FROM stems WHERE s <> ''")}),
  hints AS (SELECT stem, CASE WHEN en <> '' THEN 0 WHEN cn <> '' THEN 1 WHEN n IS NOT NULL THEN 2 WHEN tail <> '' THEN 3 END AS priority, CASE WHEN en <> '' THEN CAST(en AS INTEGER) WHEN cn <> '' THEN {_cn_sql('cn')} WHEN n IS NOT NULL THEN n WHEN tail <> '' THEN CAST(tail AS INTEGER) END AS number, en, cn, s AS roman FROM stems LEFT JOIN romans USING (s))"""


@query(f"WITH {HINTS} SELECT stem, priority, number FROM hints")
def order_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STEMS, "stem").select("stem", names.order_hint(F.col("stem")).alias("h")).select("stem", "h.priority", "h.number")


@query(f"""WITH {HINTS} SELECT stem, CAST(row_number() OVER (ORDER BY priority IS NULL, coalesce(priority, 0), coalesce(number, 0), CASE WHEN priority IS NULL THEN list_transform(regexp_extract_all(stem, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d+$') THEN '0' || lpad(x, 20, '0') ELSE '1' || lower(x) END) ELSE [lower(stem)] END) AS INTEGER) AS ordinal FROM hints""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.chapters(rows(spark, STEMS, "doc_id")).select(F.col("doc_id").alias("stem"), "ordinal")


@query(f"""WITH {HINTS} SELECT stem, CASE WHEN roman <> '' THEN upper(roman) WHEN cn <> '' THEN '第' || cn || '章' WHEN regexp_matches(upper(stem), '{names.CH_NAME}') THEN 'CH' || regexp_extract(upper(stem), '{names.CH_NAME}', 1) WHEN en <> '' THEN 'Chapter ' || CAST(en AS INTEGER) END AS tag FROM hints""")
def chapter_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STEMS, "stem").select("stem", names.chapter_tag(F.col("stem")).alias("tag"))


SCOPES = "(array('CH01', 'CH03'), '1,3', null), (array('CH01', 'CH02'), null, '1-2'), (array('a', 'b'), '1, 2', null), (array('a', 'b'), null, '1 - 2'), (array('(II) x', '(III) y'), null, null), (array('a'), null, null)"


@query("SELECT * FROM (VALUES ('CH01|CH03', 'CH01_CH03.jsonl'), ('CH01|CH02', 'CH01-CH02.jsonl'), ('a|b', 'pick_1_2.jsonl'), ('a|b', 'range_1_2.jsonl'), ('(II) x|(III) y', 'II-III.jsonl'), ('a', 'merged.jsonl')) AS t(stems, name)")
def scope_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, SCOPES, "stems, pick, span")
    return given.select(F.array_join("stems", "|").alias("stems"), names.scope_name(F.col("stems"), F.col("pick").cast("string"), F.col("span").cast("string")).alias("name"))


# Pages


@query(f"WITH {CORPUS} SELECT doc_id, page, pos, doc_id || ' / p' || page AS label, {strip_sql('text')} <> '' AS has_text, false AS has_ocr, 0 AS image_count FROM corpus")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page_keys(corpus(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT doc_id, page, pos, md5(text) AS digest FROM corpus WHERE doc_id = 'src3' ORDER BY pos LIMIT 1")
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page_lookup(corpus(spark, sf_dir), "src3").select("doc_id", "page", "pos", F.md5("text").alias("digest"))


@query(f"WITH {CORPUS} SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY pos) AS previous, lead(page) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM corpus")
def page_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.neighbours(corpus(spark, sf_dir))


FILES = "files AS (SELECT page_id, url AS path, page_id AS mtime, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section, CASE WHEN contains(url, '?') THEN 2 WHEN contains(url, '#') THEN 1 ELSE 0 END AS priority FROM pages)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", url.alias("path"), F.col("page_id").alias("mtime"), F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+/([^/?#]*)", 1).alias("section"),
        F.when(F.contains(url, F.lit("?")), 2).when(F.contains(url, F.lit("#")), 1).otherwise(0).alias("priority"),
    )


@query(f"WITH {FILES}, n AS (SELECT host, section, count(*) AS n FROM files GROUP BY ALL) SELECT host, string_agg(section, ',' ORDER BY section) AS sections, CAST(sum(n) AS BIGINT) AS file_count FROM n GROUP BY host")
def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.rollup(_files(spark, sf_dir), ["host"], "section").withColumn("sections", F.array_join("sections", ","))


@query(f"WITH {FILES} SELECT page_id, host, priority FROM files f WHERE priority = (SELECT min(priority) FROM files g WHERE g.host = f.host)")
def chapter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.first_source(_files(spark, sf_dir), ["host"], "priority").select("page_id", "host", "priority")


@query(f"WITH {FILES} SELECT host, arg_max(path, mtime) AS path FROM files GROUP BY host")
def latest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.latest(_files(spark, sf_dir), ["host"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INTEGER) AS page, {strip_sql('text')} AS text FROM conversations")
def parse_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("block", F.concat(F.lit("====== Page "), F.col("turn").cast("string"), F.lit(" ======\n"), F.col("text")))
    files = turns.groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n").alias("content"))
    return sources.page_blocks(files.withColumn("content", F.concat(F.lit("before the first header\n"), F.col("content"))))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return sources.assets(turns.select(F.col("conv_id").alias("doc_id"), F.format_string("page_%03d_img_%02d.png", F.col("turn").cast("int"), (F.col("turn") % 3).cast("int")).alias("path")))


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return said.select(F.col("conv_id").alias("doc_id"), F.format_string("page_%03d_img_%02d", F.col("turn").cast("int"), (F.col("turn") % 3).cast("int")).alias("stem"), F.col("text").alias("ocr"))


IMAGES = "images AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, CAST(turn % 3 AS INTEGER) AS img, printf('page_%03d_img_%02d.png', CAST(turn AS INTEGER), CAST(turn % 3 AS INTEGER)) AS path, CASE WHEN role = 'assistant' THEN text ELSE '' END AS ocr, role, text FROM conversations)"


@query(f"WITH {IMAGES} SELECT doc_id, page, img, path, ocr FROM images")
def attach_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_ocr(_images(spark, sf_dir), _ocr(spark, sf_dir)).select("doc_id", "page", "img", "path", "ocr")


@query(f"""WITH {IMAGES}, texts AS (SELECT doc_id, page + 1 AS page, text FROM images WHERE role <> 'assistant')
  SELECT coalesce(t.doc_id, i.doc_id) AS doc_id, coalesce(t.page, i.page) AS page, coalesce(t.text, '') AS text, coalesce(i.path, '') AS images, coalesce({strip_sql('i.ocr')}, '') AS ocr FROM texts t FULL JOIN images i ON t.doc_id = i.doc_id AND t.page = i.page""")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").where("role <> 'assistant'").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")
    pages = sources.assembled(texts, sources.with_ocr(_images(spark, sf_dir), _ocr(spark, sf_dir)))
    return pages.withColumn("images", F.array_join("images", ","))


BOXES = "('a', 1, 1, 100, 100, 1000, 1000), ('a', 1, 2, 79, 500, 1000, 1000), ('a', 2, 1, 990, 990, 1000, 1000), ('b', 1, 1, 80, 80, 500, 500), ('b', 2, 1, 10, 10, 500, 500)"


@query(f"""WITH b AS (SELECT * FROM {given_sql(BOXES, 'doc, page, img, w, h, page_w, page_h')}), k AS (SELECT doc, page, img FROM b WHERE w >= 80 AND h >= 80 AND w * h / (page_w * page_h) <= 0.9)
  SELECT * FROM k UNION ALL SELECT DISTINCT doc, page, CAST(NULL AS INTEGER) FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = b.doc AND k.page = b.page)""")
def image_crop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.crop_rule(given(spark, sf_dir, BOXES, "doc, page, img, w, h, page_w, page_h"))


IMAGE_ROWS = """('a.png', '["b.png", " a.png ", {"path": "c.png", "images": ["d.png", ["e.png"]]}]'), (null, '{"url": "u.png", "name": "n.png"}'), ('', null)"""


@query("SELECT * FROM (VALUES ('a.png', 'a.png,b.png,c.png,d.png,e.png'), (NULL, 'n.png,u.png'), ('', '')) AS t(image, paths)")
def flatten_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, IMAGE_ROWS, "image, images").select("image", F.col("images").cast("string").alias("images"))
    return given.select("image", F.array_join(sources.images_of("image", "images"), ",").alias("paths"))


# Exams


@query(rf"""WITH s AS (SELECT doc_id AS pos, {strip_sql('text')} AS s FROM documents), f AS (SELECT pos, s, {squeeze_sql(strip_sql("string_split(s, chr(10))[1]"))} AS first FROM s WHERE s <> ''),
  t AS (SELECT pos, {squeeze_sql(rf"CASE WHEN regexp_matches(first, '^\d+[-－]\d+.*$') THEN first ELSE {strip_sql('left(s, 60)')} END")} AS topic FROM f WHERE length(first) >= 4 AND NOT regexp_matches(first, '^CH\d+\s*[　 ].*$'))
  SELECT topic, min(pos) AS pos FROM t WHERE length(topic) >= 12 AND (contains(topic, ' ') OR length(topic) >= 20) AND NOT regexp_matches(topic, '^[0-9A-Za-z\-\.\(\) ]+$') GROUP BY topic ORDER BY min(pos) LIMIT 300""")
def topic_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exam.topics(corpus(spark, sf_dir))


@query(f"SELECT lower({strip_sql(squeeze_sql('text'))}) AS key, min(conv_id * 1000 + turn) AS at FROM conversations GROUP BY ALL")
def dedup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exam.distinct_questions(table(spark, sf_dir, "conversations").select(F.col("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at")), "at")


@query("SELECT d.source AS exam, count(*) FILTER (WHERE quality = toxic) AS correct, count(*) FILTER (WHERE quality <> toxic) AS wrong, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source")
def grade_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("exam")), "doc_id")
    return exam.graded(given.select("exam", F.col("quality").alias("answer"), F.col("toxic").alias("given")), "exam").withColumn("accuracy", F.round("accuracy", 6))


MCQ = """(1, '{"question":"What?","options":{"A":"a","B":"b","C":"c","D":"d"},"answer":"A","explanation":[{"text":"as \\\\"the tree\\\\" says","sources":["[1]","[2]","[1]"]}]}'),
 (2, '{"question":"What?\\\\n A) a","options":{"A":"a","B":"b","C":"c","D":"d"},"answer":"A","explanation":[{"text":"x","sources":["[1]"]}]}'),
 (3, '{"question":"What?","options":{"A":"a","B":"b","C":"c"},"answer":"A","explanation":[{"text":"x","sources":["[1]"]}]}'),
 (4, '{"question":"What?","options":{"A":"a","B":"NOT_FOUND","C":"c","D":"[3]"},"answer":"B","explanation":[{"text":"x","sources":["[1]"]}]}'),
 (5, '{"question":"What?","options":{"A":"a","B":"b","C":"c","D":"d"},"answer":"E","explanation":[{"text":"x","sources":["[1]"]}]}'),
 (6, '{"question":"What?","options":{"A":"a","B":"b","C":"c","D":"d"},"answer":"D","explanation":[{"text":"x \\\\"a bush\\\\"","sources":[]}]}'),
 (7, '{"question":"What?","options":{"A":"a","B":"b","C":"c","D":"d"},"answer":"D","explanation":[]}')"""


@query("SELECT * FROM (VALUES (1, true, true, '[1],[2]', '[1]'), (2, false, false, '[1]', '[1]'), (3, false, false, '[1]', '[1]'), (4, false, false, '[1]', '[1]'), (5, false, false, '[1]', '[1]'), (6, false, false, '', ''), (7, false, false, '', '')) AS t(id, valid, quoted, used, cited)")
def validate_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, MCQ, "id, raw").select("id", F.from_json("raw", exam.QUESTION).alias("q")).select("id", "q.*")
    used = exam.used_sources()
    known = F.create_map(F.lit("[1]"), F.lit("ch1/p1"), F.lit("[3]"), F.lit("ch1/p3"))
    return asked.select("id", exam.valid_question().alias("valid"), exam.quotes_context(F.lit("here is the tree of it")).alias("quoted"), F.array_join(used, ",").alias("used"), F.array_join(F.map_keys(exam.restricted(known, used)), ",").alias("cited"))


LOG = """#1 score=0.9000\ndoc_id=ch1 page=3\nimages=['a.png', \"b.jpg\"]\nOCR:\nseen\nTEXT:\nline one\nline two\n--------------------\nnoise\n#2 score=0.5\ndoc_id=ch2 page=x\nTEXT:\nlast"""


@query("SELECT * FROM (VALUES (1, CAST(0.9 AS DOUBLE), 'ch1', '3', 'a.png,b.jpg', 'seen', 'line one' || chr(10) || 'line two'), (2, CAST(0.5 AS DOUBLE), 'ch2', 'x', '', '', 'last')) AS t(rank, score, doc_id, page, images, ocr, text)")
def parse_result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.result_log(spark.createDataFrame([(1, LOG)], "log_id int, log string"))
    return found.select("rank", "score", "doc_id", "page", F.array_join("images", ",").alias("images"), "ocr", "text")


from . import extra  # noqa: E402, F401  registers its queries with the helpers above
