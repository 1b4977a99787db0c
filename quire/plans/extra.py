"""More queries over the synthetic tables, with their SQL: answers, listings, exams, files and addresses.

Registered by registry, whose helpers they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display, names, text
from ..operators import answers, browse, exam, keywords, listing, search
from ..providers import SilentModel
from ..sources import artifacts, documents
from ..sources import pages as sources
from .registry import BLOBS, CORPUS, QUESTIONS, SCORES, STEMS, TASK_SQL, TERMS, VARIANTS, _in, _replace_sql, _scored, corpus, query, rows, squeeze_sql, strip_sql, table

HINT_PARTS = f"""stems AS (SELECT stem, regexp_extract(stem, '{names.EN_CHAPTER}', 1) AS en, regexp_extract(stem, '{names.CN_CHAPTER}', 1) AS cn, regexp_extract(stem, '{names.ROMAN_CHAPTER}', 1) AS roman, regexp_extract(upper(stem), '{names.CH_NAME}', 1) AS ch FROM (VALUES {STEMS}) AS t(stem))"""


# Answers

HEADS = f"'{answers.TEMPLATE_HEAD}' || q.text || chr(10) || '{answers.TEMPLATE_INTRO['en']}' || chr(10) || chr(10)"
SHORT = f"CASE WHEN length({squeeze_sql('d.text')}) > 220 THEN rtrim(left({strip_sql(squeeze_sql('d.text'))}, 220)) || '...' ELSE {strip_sql(squeeze_sql('d.text'))} END"


@query(f"""WITH {BLOBS}, {VARIANTS}, hits AS (SELECT item_id AS query_id, doc_id, page, pos, min(variant) AS variant FROM blobs JOIN variants ON contains(blob, form) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, pos) AS rank FROM hits),
  top AS (SELECT r.query_id, r.rank, '[' || r.rank || '] ' || r.doc_id || ' / p' || r.page || ' (score=1.0000)' || chr(10) || {SHORT} || chr(10) AS entry, r.doc_id || '/p' || r.page AS cite FROM ranked r JOIN documents d ON d.doc_id = r.pos WHERE r.rank <= 15 AND {strip_sql('d.text')} <> ''),
  told AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS body, count(*) FILTER (WHERE rank <= 3) AS n, string_agg(cite, ',' ORDER BY rank) AS cites FROM top GROUP BY query_id)
  SELECT q.item_id AS query_id, CASE WHEN n IS NULL THEN 'none' ELSE 'template' END AS origin, CASE WHEN n IS NULL THEN '{answers.NO_HITS}' ELSE {HEADS} || body || chr(10) || 'SOURCES: ' || array_to_string(list_transform(range(1, n + 1), lambda i: '[' || i || ']'), ', ') END AS answer, coalesce(cites, '') AS cites
  FROM benchmark q LEFT JOIN told ON told.query_id = q.item_id""")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = answers.answered(corpus(spark, sf_dir), asked, SilentModel(), None, max_chars=1 << 30)
    return out.select("query_id", "origin", "answer", F.coalesce(F.array_join("cites", ","), F.lit("")).alias("cites"))


@query(f"SELECT q, CASE WHEN {TASK_SQL} = 'process' THEN coalesce(nullif({strip_sql(squeeze_sql(_replace_sql('q', text.TOPIC_FILLERS)))}, ''), nullif(q, '')) || CASE WHEN regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') THEN '{text.SEARCH_SUFFIXES['cn']}' ELSE '{text.SEARCH_SUFFIXES['en']}' END ELSE q END AS query FROM (SELECT q FROM (VALUES {QUESTIONS}) AS t(q) UNION ALL SELECT text FROM benchmark)")
def retrieval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, QUESTIONS, "q").unionByName(table(spark, sf_dir, "benchmark").select(F.col("text").alias("q")))
    return asked.select("q", text.retrieval_query(F.col("q")).alias("query"))


CORE_SQL = f"CASE WHEN regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') THEN '{answers.CORE_RULES['cn']}' ELSE '{answers.CORE_RULES['en']}' END"
RULES_SQL = "CASE " + " ".join(f"WHEN {'' if lang == 'cn' else 'NOT '}cjk AND task = '{kind}' THEN '{rule}'" for (lang, kind), rule in answers.TASK_RULES.items()) + " END"


@query(f"WITH t AS (SELECT q, {CORE_SQL} AS core, regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') AS cjk, {TASK_SQL} AS task FROM (SELECT q FROM (VALUES {QUESTIONS}) AS v(q) UNION ALL SELECT text FROM benchmark)) SELECT q, '{answers.ANSWER_ROLE}' || chr(10) || core || chr(10) || {RULES_SQL} AS system, 'QUESTION:' || chr(10) || q || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || 'c' AS user_text FROM t")
def answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, QUESTIONS, "q").unionByName(table(spark, sf_dir, "benchmark").select(F.col("text").alias("q")))
    system, user = answers.answer_prompt(F.col("q"), F.lit("c"))
    return asked.select("q", system.alias("system"), user.alias("user_text"))


@query("""WITH flat AS (SELECT label, vec_id % 3 AS m, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT label, CAST(i AS INTEGER) AS i, round(sum(CAST(x AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS value FROM flat GROUP BY label, i""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "embeddings").withColumn("m", F.col("vec_id") % 3)
    return search.mean_pooled(rows_, "label", "embedding", "m").withColumn("value", F.round("value", 6))


# Terms and listings


@query(f"WITH {TERMS.split('kept AS')[0].rstrip().rstrip(',')} SELECT doc_id, pos, term, count(*) AS hits FROM flat WHERE term NOT IN {_in(keywords.STOP_EN)} GROUP BY ALL")
def extract_terms_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.page_terms(corpus(spark, sf_dir)).select("doc_id", "pos", "term", "hits")


@query(f"WITH {SCORES} SELECT doc_id, CAST(rank AS INTEGER) AS n, term, false AS fallback FROM ranked WHERE doc_id = 'src3' AND rank <= 8")
def keyword_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = keywords.ranked(_scored(spark, sf_dir), 10).select("doc_id", "rank", "term")
    allowed = spark.createDataFrame([("src3", ["spare"])], "doc_id string, terms array<string>")
    return listing.shown(tips, allowed, "src3", 8)


@query("SELECT source AS doc_id, CAST(row_number() OVER (ORDER BY min(doc_id)) AS INTEGER) AS n, lang AS term, true AS fallback FROM documents WHERE source = (SELECT min(source) FROM documents) GROUP BY source, lang ORDER BY min(doc_id) LIMIT 3")
def keyword_listing_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("at"))
    allowed = first.groupBy(F.col("source").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lang"))), lambda x: x["lang"]).alias("terms"))
    return listing.shown(spark.createDataFrame([], "doc_id string, rank int, term string"), allowed, "no such", 3)


@query(f"""WITH {SCORES}, marked AS (SELECT *, rank IN (2, 4, 5) AS own FROM ranked WHERE rank <= 50), placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, rank) AS place FROM marked)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS INTEGER) AS rank, term FROM placed WHERE own OR place <= 6""")
def kept_and_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = keywords.ranked(_scored(spark, sf_dir), 50)
    ids = best.select("doc_id").distinct().withColumn("ids", F.array(F.lit(3), F.lit(1), F.lit(4)))
    return listing.kept_and_filled(best, ids, 6).select("doc_id", "rank", "term")


@query(f"""WITH {CORPUS}, b AS (SELECT doc_id, pos, text || chr(10) AS blob FROM corpus WHERE {strip_sql('text')} <> ''), j AS (SELECT doc_id, left(string_agg(blob, chr(10) ORDER BY pos), 18000) AS t FROM b GROUP BY doc_id)
  SELECT doc_id, CAST(ceil(length(t) / 3000.0) AS INTEGER) AS n, md5(t) AS digest FROM j""")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.chapter_texts(corpus(spark, sf_dir)).select("doc_id", F.size("chunks").alias("n"), F.md5(F.array_join("chunks", "")).alias("digest"))


STOP_SQL = rf"(low = '' OR low IN {_in(keywords.STOP_TERMS + keywords.FORMAT_NOISE)} OR regexp_extract(low, '\.([^.]*)$', 1) IN {_in(keywords.FORMAT_NOISE)} OR regexp_matches(low, '://|/|\\') OR regexp_matches(low, '^[^a-z\x{{80}}-\x{{10ffff}}]+$') OR regexp_matches(low, '^[a-z]{{1,2}}$'))"


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(url, '[?=&#]')) AS term FROM pages UNION SELECT DISTINCT regexp_replace(unnest(string_split(text, ' ')), '[^ -~]', '', 'g') FROM conversations), t AS (SELECT term, lower({strip_sql('term')}) AS low FROM w) SELECT term, {STOP_SQL} AS stop FROM t")
def stop_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select(F.explode(F.split("url", "[?=&#]")).alias("term")).union(table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w")).select(F.regexp_replace("w", "[^ -~]", ""))).distinct()
    return found.select("term", keywords.is_stop(F.col("term")).alias("stop"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') AS terms FROM conversations")
def listed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.listed_terms(F.col("text")), "|").alias("terms"))


ALLOWED = """('{"src1": ["b", " a ", "b", ""], "__meta__": ["x"], " src2 ": [], "src3": ["c"], "": ["d"]}'), ('no json'), ('{"src4": "text"}')"""


@query("SELECT * FROM (VALUES ('src1', 'b,a'), ('src3', 'c')) AS t(doc_id, terms)")
def read_allowed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, ALLOWED, "raw").select(F.explode(listing.read_allowed(F.col("raw"))).alias("doc_id", "t")).select("doc_id", F.array_join("t", ",").alias("terms"))


# Exams


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question made of every turn: options are its first words, the explanation quotes its beginning."""
    turns = table(spark, sf_dir, "conversations")
    word = lambda k: F.coalesce(F.get(F.split("text", " "), k), F.lit(""))
    options = F.create_map(*(x for k, name in enumerate("ABCD") for x in (F.lit(name), word(k))))
    sources = F.when(F.col("turn") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")), F.lit("[1]"), F.lit("x")))
    said = F.concat(F.lit('see "'), F.left("text", F.lit(9)), F.lit('"'))
    return turns.select("conv_id", "turn", F.col("text").alias("question"), options.alias("options"), F.substring(F.lit("ABCDE"), (F.col("turn") % 5).cast("int") + 1, F.lit(1)).alias("answer"), F.array(F.struct(said.alias("text"), sources.alias("sources"))).alias("explanation"))


OPTION_OK = " AND ".join(rf"(len(w) > {k} AND {strip_sql(f'w[{k + 1}]')} NOT IN ('', 'NOT_FOUND') AND NOT regexp_matches({strip_sql(f'w[{k + 1}]')}, '^\[\d+\]$'))" for k in range(4))


@query(rf"""WITH c AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w FROM conversations)
  SELECT conv_id, turn, NOT regexp_matches(text, '\n\s*[ABCD]\)') AND NOT regexp_matches(text, '\n\s*[ABCD]\.') AND NOT regexp_matches(text, '\b[ABCD][\)\.]\s') AND turn % 5 < 4 AND turn % 3 <> 0 AND {OPTION_OK} AS valid FROM c""")
def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("conv_id", "turn", exam.valid_question().alias("valid"))


@query("""WITH c AS (SELECT conv_id, turn, left(text, 9) AS quote, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS later, text FROM conversations)
  SELECT conv_id, turn, length(quote) >= 3 AND NOT contains(quote, '"') AND contains(CASE WHEN turn % 2 = 0 THEN text ELSE coalesce(later, '') END, quote) AS quoted FROM c""")
def verbatim_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy("turn")
    asked = _said(spark, sf_dir).withColumn("context", F.when(F.col("turn") % 2 == 0, F.col("question")).otherwise(F.coalesce(F.lead("question").over(by), F.lit(""))))
    return asked.select("conv_id", "turn", exam.quotes_context(F.col("context")).alias("quoted"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn = 1 THEN '[1]' ELSE '[' || turn || '],[1]' END AS used, CASE WHEN turn % 3 = 0 THEN '' WHEN turn = 2 THEN '[1],[2]' ELSE '[1]' END AS cited FROM conversations")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit("[1]"), F.lit("a"), F.lit("[2]"), F.lit("b"), F.lit("[9999]"), F.lit("c"))
    used = exam.used_sources()
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(used, ",").alias("used"), F.array_join(F.array_sort(F.map_keys(exam.restricted(known, used))), ",").alias("cited"))


@query(r"SELECT doc_id, length(text) >= 500 AND NOT (len(regexp_extract_all(text, '\bCH\d+\b')) >= 3 AND length(text) < 1000) AND NOT regexp_matches(source, '(?i)^CH\d+(?:-CH\d+)?$') AS fit FROM documents")
def context_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", exam.context_ok(F.col("text"), F.col("source")).alias("fit"))


# Files, addresses and names


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("_"), "source")).otherwise(F.col("source"))
    name = F.when(F.col("doc_id") % 11 == 0, F.col("source")).otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/d/"), folder, F.lit("/"), name, F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".md")).alias("path")).distinct()


@query("""WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN '_' || source ELSE source END AS folder, CASE WHEN doc_id % 11 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS stem, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS ext FROM documents)
  SELECT folder, '/d/' || folder || '/' || arg_min(stem, struct_pack(other := stem <> folder, name := stem || ext)) || '.txt' AS path FROM p WHERE ext = '.txt' AND NOT starts_with(folder, '_') GROUP BY folder""")
def document_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_folders(_paths(spark, sf_dir))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS new, count(*) FILTER (WHERE role = 'assistant') AS skipped, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS failed FROM conversations GROUP BY conv_id")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("role") == "user", "new").when(F.col("role") == "assistant", "skipped").otherwise("failed")
    return documents.status_counts(table(spark, sf_dir, "conversations").withColumn("status", status), "conv_id")


@query("SELECT conv_id AS doc_id, string_agg('====== Page ' || turn || ' ======' || chr(10) || coalesce(nullif(text, ''), '這頁是沒有txt的'), chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.page_file(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text"))


@query(rf"SELECT doc_id, {strip_sql('text')} <> '' AND doc_id % 3 <> 0 AS effective FROM documents")
def effective_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("== Page 1 ==\n"), F.when(F.col("doc_id") % 3 == 0, F.lit(text.NO_TEXT)).otherwise(F.col("text")), F.lit("\n=== page 2 ===\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_effective_text(content).alias("effective"))


@query("SELECT page_id, '/static/' || replace(replace(replace(url_encode(url), '%2F', '/'), '%28', '('), '%29', ')') AS address FROM pages")
def static_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.static_url(F.col("url")).alias("address"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/other/' || url END AS path FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.when(F.col("page_id") % 2 == 0, "/data/").otherwise("/other/")
    return table(spark, sf_dir, "pages").select("page_id", text.relative_path(F.concat(root, "url"), "/data").alias("path"))


URL_NAME = "regexp_extract(url, '([^/]*)$', 1)"


@query(f"""WITH f AS (SELECT DISTINCT url AS path, {URL_NAME} AS name FROM pages), a AS (SELECT DISTINCT {URL_NAME} AS name FROM pages WHERE page_id % 3 = 0)
  SELECT './' || a.name AS image, arg_min(path, struct_pack(k := CASE WHEN path = a.name THEN 0 WHEN contains(path, 'raw_img') THEN 1 ELSE 2 END, p := path)) AS path FROM a JOIN f USING (name) WHERE name <> '' GROUP BY a.name""")
def resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages")
    asked = urls.where("page_id % 3 = 0").select(F.concat(F.lit("./"), F.regexp_extract("url", r"([^/]*)$", 1)).alias("image")).distinct().where("image <> './'")
    return browse.resolved_images(asked, urls.select(F.col("url").alias("path")).distinct())


@query("SELECT page_id, array_to_string(CASE WHEN page_id % 2 = 0 THEN [url, 'u' || page_id || '.png', 'last.png'] ELSE ['u' || page_id || '.png', url, 'last.png'] END, '|') AS paths FROM pages")
def image_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("u"), F.col("page_id").cast("string"), F.lit(".png"))
    first = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(', "rel_path": "'), F.col("url"), F.lit('"'))).otherwise("")
    nested = F.concat(F.lit('[{"images": [{"path": " '), name, F.lit('"}, {"url": "'), name, F.lit('"}], "other": "no"'), first, F.lit('}, {"name": "'), "url", F.lit('", "images": ["last.png"]}]'))
    given = table(spark, sf_dir, "pages").select("page_id", F.lit(" ").alias("image"), nested.alias("images"))
    return given.select("page_id", F.array_join(sources.images_of("image", "images"), "|").alias("paths"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'a.png' END AS image FROM pages")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), "url")).otherwise(F.lit(" "))
    images = F.when(F.col("page_id") % 3 == 1, F.array(F.lit("a.png"), F.lit("b.png"))).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", sources.first_image(image, images).alias("image"))


@query(r"SELECT page_id, TRY_CAST(CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9]{1,9}$') THEN regexp_extract(url, '[^/]*$') END AS INTEGER) AS page FROM pages")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sources.page_number(F.concat(F.lit(" "), F.regexp_extract("url", "[^/]*$", 0))).alias("page"))


@query(f"WITH {HINT_PARTS} SELECT stem, CASE WHEN roman <> '' THEN upper(roman) WHEN en <> '' THEN CAST(CAST(en AS INTEGER) AS VARCHAR) WHEN cn = '三' THEN '3' WHEN cn = '十二' THEN '12' WHEN cn <> '' THEN cn WHEN ch <> '' THEN ch END AS label FROM stems")
def chapter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STEMS, "stem").select("stem", names.chapter_label(F.col("stem")).alias("label"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("x"))
    return listed.select("conv_id", text.joined_text(F.col("x")).alias("joined"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", artifacts.stamp(F.col("ts")).alias("stamp"))


@query(f"WITH {CORPUS} SELECT pos, doc_id, page, {strip_sql('text')} AS text FROM corpus WHERE {strip_sql('text')} <> ''")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.index_rows(corpus(spark, sf_dir).withColumn("images", F.array().cast("array<string>"))).select("pos", "doc_id", "page", "text")


@query(f"""SELECT conv_id AS log_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS record, CAST(turn AS INTEGER) AS rank, CAST(0.5 AS DOUBLE) AS score, role AS doc_id, CAST(turn AS VARCHAR) AS page, CASE WHEN turn % 2 = 0 THEN 'a.png,B.JPG' ELSE '' END AS images,
  CASE WHEN role = 'user' THEN {strip_sql('text')} ELSE '' END AS ocr, {strip_sql('text')} AS text FROM conversations""")
def read_result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a.png"), F.lit("B.JPG"))).otherwise(F.array().cast("array<string>"))
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.lit(0.5).alias("score"), F.col("role").alias("doc_id"), F.col("turn").alias("page"), images.alias("images"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("ocr"), "text")
    told = sources.printed(hits).groupBy(F.col("conv_id").alias("log_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "printed"))), lambda x: x["printed"]), "\n").alias("log"))
    return sources.result_log(told).withColumn("images", F.array_join("images", ","))


# What is shown


@query(r"SELECT doc_id, CASE WHEN n_chars IS NULL THEN '未知大小' WHEN n_chars * doc_id < 1024 THEN (n_chars * doc_id) || ' bytes' WHEN n_chars * doc_id < 1048576 THEN printf('%.1f KB', floor(n_chars * doc_id / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars * doc_id / 1048576.0 * 10 + 0.5) / 10) END AS size FROM documents")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", display.size_text(F.col("n_chars") * F.col("doc_id")).alias("size"))


@query("SELECT path, size, modified, path || '::' || size || '::' || modified AS key FROM (SELECT DISTINCT lang || '/' || source AS path, n_chars % 7 AS size, doc_id % 3 AS modified FROM documents)")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("path"), (F.col("n_chars") % 7).alias("size"), (F.col("doc_id") % 3).alias("modified"))
    every = display.with_new_files(files.where("doc_id % 2 = 0"), files.where("doc_id % 2 = 1 OR doc_id % 4 = 0"))
    return every.withColumn("key", display.file_key(*(F.col(c) for c in ("path", "size", "modified"))))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, 'data/' || url AS shown FROM pages")
def built_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("D:\\work\\data\\"), F.replace("url", F.lit("/"), F.lit("\\")))
    return table(spark, sf_dir, "pages").select("page_id", display.built_name(F.concat(path, F.lit(".JSONL"))).alias("name"), display.display_path(path).alias("shown"))


@query(r"""SELECT conv_id, turn, coalesce(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), '(無輸出)') AS log, least(turn, conv_id) || '-' || greatest(turn, conv_id) AS span FROM conversations""")
def shown_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit("\r\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", display.log_text(log).alias("log"), display.span_text(F.col("turn"), F.col("conv_id")).alias("span"))
