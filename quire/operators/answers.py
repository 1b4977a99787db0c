"""Question answering over a searched corpus: retrieve, pack, ask, and fall back.

Questions are a stated set. Task, search depth and query per question, hybrid hits,
packed context and prompts are plans; hits are written once, as are the replies of the
model, in a journal, before anything branches on them. Only questions whose answer is
not usable are asked a second time, for a summary, and a template of the best hits
stands in for the rest: n questions give n rows after at most 2 n calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, retrieval_query, search_depth, task_type, usable_answer
from ..functions.text import answer_tokens as tokens_of
from ..providers import Embedder, LanguageModel, embedded
from ..sources.scratch import kept
from . import search
from .journal import Journal

#: Rules of every answer, and of the kinds of questions, by language. The table columns and the way to cite are part of the contract with readers of the answers.
CORE_RULES = {
    "cn": "回答請用繁體中文，內容僅限於 CONTEXT，勿加入其他知識。CONTEXT 不足時，說明檢索到的內容主要談什麼。每個主要概念或結論都附上來源頁碼，例如 CH05/p39。",
    "en": "Write the answer in English and take it from the CONTEXT alone, without other knowledge. Where the CONTEXT does not suffice, say what it mainly deals with. Give a source page, such as CH05/p39, with each main concept or conclusion.",
}
TASK_RULES = {
    ("cn", "process"): "題型：步驟。CONTEXT 若沒有標準流程，先聲明以下流程是由檢索內容歸納而來。以表格作答，欄位依序為 步驟、目的、相關技術、根據 CONTEXT 的說明、來源頁碼；沒有來源的列不要寫。",
    ("cn", "compare"): "題型：比較。以表格作答，欄位依序為 項目、用途/定義、主要差異、來源頁碼；CONTEXT 中找不到的項目寫「未找到」。",
    ("cn", "summary"): "題型：整理。條列重點，各點附來源頁碼，只寫 CONTEXT 支持的內容。",
    ("cn", "qa"): "題型：問答。先寫 CONTEXT 支持的部分，再說明缺少什麼；除非完全無關，不要一開始就說無法回答。簡潔並附來源頁碼。",
    ("en", "process"): "Kind: steps. If the CONTEXT defines no standard process, say that the steps are inferred from what was retrieved. Use a table of Step, Purpose, Related Techniques, CONTEXT-based Explanation, Source Page; leave out rows without a source.",
    ("en", "compare"): "Kind: comparison. Use a table of Item, Definition/Use, Main Difference, Source Page; mark items that the CONTEXT lacks as not found.",
    ("en", "summary"): "Kind: summary. Use bullet points with source pages, and only what the CONTEXT supports.",
    ("en", "qa"): "Kind: question. Give what the CONTEXT supports first, then what is missing; do not begin with a refusal unless nothing is related. Be concise and give source pages.",
}
ANSWER_ROLE = "You answer questions about an offline collection of course pages and keep to these rules."
SUMMARY_ROLE = "You summarise retrieved passages of course pages, briefly and from the passages alone."
SUMMARY_TASK = "Say what the passages state. If they do not answer the question, name their main topic."
# The first lines of the template answer, by language, and what stands for a question without hits.
TEMPLATE_HEAD = "[TEMPLATE FALLBACK] "
TEMPLATE_INTRO = {"cn": "目前無法穩定生成回答，以下是最相關段落重點：", "en": "The QA step was not usable. Most relevant retrieved snippets:"}
NO_CONTEXT, NO_HITS = "[no retrievable context found]", "目前檢索不到符合相關性門檻的教材內容。"
#: Tokens of a summary.
SUMMARY_TOKENS = 256


def _by_language(question: Column, table: dict[str, str]) -> Column:
    return F.when(question.rlike(CJK), table["cn"]).otherwise(table["en"])


def policy(question: Column) -> Column:
    """The rules for an answer, by the language and kind of the question."""
    task = task_type(question)
    rules = F.lit(None).cast("string")
    for (lang, kind), text in TASK_RULES.items():
        rules = F.when((task == kind) & (question.rlike(CJK) if lang == "cn" else ~question.rlike(CJK)), text).otherwise(rules)
    return F.concat(_by_language(question, CORE_RULES), F.lit("\n"), rules)


def answer_prompt(question: Column, context: Column) -> tuple[Column, Column]:
    """(system, user) for an answer."""
    return F.concat(F.lit(ANSWER_ROLE + "\n"), policy(question)), F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nCONTEXT:\n"), context)


def summary_prompt(question: Column, context: Column) -> tuple[Column, Column]:
    """(system, user) for a summary of what was retrieved."""
    return F.concat(F.lit(SUMMARY_ROLE + "\n"), policy(question)), F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nRETRIEVED CONTEXT:\n"), context, F.lit("\n\n" + SUMMARY_TASK))


def template_answer(question: Column, snippets: Column) -> Column:
    """The answer made of the best snippets (search.fallback_answer), null if there are none."""
    body = F.coalesce(snippets, F.lit(NO_CONTEXT))
    return F.concat(F.lit(TEMPLATE_HEAD), question, F.lit("\n"), _by_language(question, TEMPLATE_INTRO), F.lit("\n\n"), body)


def retrieved(index: DataFrame, questions: DataFrame, embedder: Embedder | None, k: int = 15, min_similarity: float | None = search.MIN_SIMILARITY) -> DataFrame:
    """Hits (query_id, rank, branch, score, doc_id, page, text, ocr) of questions (query_id, question): exact before vector ones, each page once, at most as many as the kind of question takes."""
    asked = questions.select("query_id", retrieval_query(F.col("question")).alias("query"), search_depth(task_type(F.col("question")), F.lit(k)).alias("depth"))
    exact = search.exact_search_batch(index, asked.select("query_id", "query"), k).select("query_id", F.lit(0).alias("branch"), "rank", F.lit(1.0).alias("score"), "doc_id", "page")
    hits = exact
    if embedder is not None:
        vectors = asked.select("query_id", embedded(F.col("query"), embedder).alias("vector"))
        near = search.vector_search_batch(index.where("embedding IS NOT NULL"), vectors, k, min_similarity)
        near = near.join(index.select("pos", "doc_id", "page"), "pos")
        hits = exact.unionByName(near.select("query_id", F.lit(1).alias("branch"), "rank", "score", "doc_id", "page"))
    first = hits.groupBy("query_id", "doc_id", "page").agg(F.min(F.struct("branch", "rank", "score")).alias("h")).select("query_id", "doc_id", "page", "h.branch", F.col("h.rank").alias("at"), "h.score")
    by = Window.partitionBy("query_id").orderBy("branch", "at")
    ranked = first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).join(asked.select("query_id", "depth"), "query_id").where(F.col("rank") <= F.col("depth"))
    texts = index.groupBy("doc_id", "page").agg(F.min_by(F.struct("text", "ocr"), "pos").alias("t"))
    told = ranked.alias("r").join(texts.alias("t"), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.page").eqNullSafe(F.col("t.page")))
    return told.select("query_id", "rank", "branch", "score", "r.doc_id", "r.page", "t.t.text", "t.t.ocr")


def answered(index: DataFrame, questions: DataFrame, model: LanguageModel, embedder: Embedder | None = None, k: int = 15, min_similarity: float | None = search.MIN_SIMILARITY, max_chars: int = 9000, per_hit: int = 700, journal: Journal | None = None) -> DataFrame:
    """(query_id, question, answer, origin, cites) per question (query_id, question); origin: answer, summary, template or none (no hits).

    journal: where replies are kept and looked up; without one, they serve this call alone.
    """
    journal = journal or Journal(index.sparkSession)
    hits = kept(retrieved(index, questions, embedder, k, min_similarity), "hits")
    packed = search.packed_context(hits, max_chars, per_hit)
    snippets = search.fallback_answer(hits).withColumnRenamed("answer", "snippets")
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    rows = questions.select("query_id", "question").join(found, "query_id", "left").join(packed, "query_id", "left").join(snippets, "query_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    rows = kept(rows, "questions")
    question, plain = F.col("question"), F.coalesce("question", F.lit(""))
    said = journal.asked(rows.where("n_hits IS NOT NULL"), *answer_prompt(plain, F.col("context")), tokens_of(task_type(question)), model, "answer")
    poor = journal.asked(said.where(~usable_answer(F.col("answer"))), *summary_prompt(plain, F.col("context")), F.lit(SUMMARY_TOKENS), model, "summary")
    good = usable_answer(F.col("summary"))
    parts = [
        said.where(usable_answer(F.col("answer"))).select("query_id", "question", "answer", F.lit("answer").alias("origin"), "cites"),
        poor.select("query_id", "question", F.when(good, F.col("summary")).otherwise(template_answer(question, F.col("snippets"))).alias("answer"), F.when(good, "summary").otherwise("template").alias("origin"), "cites"),
        rows.where("n_hits IS NULL").select("query_id", "question", F.lit(NO_HITS).alias("answer"), F.lit("none").alias("origin"), "cites"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
