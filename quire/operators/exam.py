"""Question sets: topics, validation, sources, grading."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_TEXT, squeeze, strip

QUESTION = "question STRING, options MAP<STRING, STRING>, answer STRING, explanation ARRAY<STRUCT<text: STRING, sources: ARRAY<STRING>>>"

#: What ends a line, within a class of characters.
_BREAKS = r"\n\x0B\f\r\x{85}\x{2028}\x{2029}"


def topics(pages: DataFrame, limit: int | None = 300) -> DataFrame:
    """(topic, pos): headings and first sentences fit for retrieval, distinct, in page order."""
    # a first line may be a whole long text: what is asked of it is seen at its beginning, and only numbered ones are read to their end
    text, inside = F.coalesce("text", F.lit("")), rf"[\s&&[^{_BREAKS}]]"
    head = strip(F.regexp_extract(text, r"(?sU)^\s*+(\S.{0,59})", 1))
    line = squeeze(strip(F.regexp_extract(text, rf"(?U)^\s*+(\S[^{_BREAKS}]*+)", 1)))
    numbered, few = text.rlike(r"(?U)^\s*+\d+[-－]\d"), ~text.rlike(rf"(?U)^\s*+\S(?:\S|{inside}++(?=\S)){{3}}")
    chapter = text.rlike(rf"(?U)^\s*+CH[0-9]++{inside}++\S")
    rows = pages.where(~few & ~chapter).select("pos", head.alias("head"), squeeze(F.when(numbered, line).otherwise(head)).alias("topic")).where(F.col("head") != NO_TEXT)
    t = F.col("topic")
    rows = rows.where((F.length(t) >= 12) & (F.contains(t, F.lit(" ")) | (F.length(t) >= 20)) & ~t.rlike(r"^[0-9A-Za-z\-\.\(\) ]+$"))
    out = rows.groupBy("topic").agg(F.min("pos").alias("pos"))
    return out.orderBy("pos").limit(limit) if limit else out


def valid_question() -> Column:
    """Four filled options that are neither placeholders nor tags, none of them in the stem, a legal answer, and sources in every explanation."""
    question, options = F.coalesce("question", F.lit("")), F.col("options")
    ok = ~question.rlike(r"\n\s*[ABCD]\)") & ~question.rlike(r"\n\s*[ABCD]\.") & ~question.rlike(r"\b[ABCD][\)\.]\s") & strip(F.coalesce("answer", F.lit(""))).isin("A", "B", "C", "D")
    for k in "ABCD":
        v = strip(F.coalesce(F.try_element_at(options, F.lit(k)), F.lit("")))
        ok = ok & ~v.isin("", "NOT_FOUND") & ~v.rlike(r"^\[\d+\]$")
    sourced = F.forall("explanation", lambda e: F.coalesce(F.size(e["sources"]), F.lit(0)) > 0)
    return F.coalesce(ok & (F.size("explanation") > 0) & sourced, F.lit(False))


def quotes_context(context: Column) -> Column:
    """Does an explanation quote 3 to 120 characters that stand in the context?"""
    return F.coalesce(F.exists("explanation", lambda e: F.exists(F.regexp_extract_all(F.coalesce(e["text"], F.lit("")), F.lit(r'"([^"]{3,120})"'), F.lit(1)), lambda q: F.contains(context, q))), F.lit(False))


def used_sources() -> Column:
    """The tags that explanations cite, once each, in order."""
    return F.array_distinct(F.filter(F.flatten(F.transform("explanation", lambda e: F.coalesce(e["sources"], F.array().cast("array<string>")))), lambda s: s.rlike(r"^\[\d+\]$")))


def restricted(sources: Column, used: Column) -> Column:
    return F.map_filter(sources, lambda k, v: F.array_contains(used, k))


def context_ok(context: Column, topic: Column) -> Column:
    """Long enough, not a mere list of chapters, and not for a bare chapter label."""
    labels = F.regexp_count(context, F.lit(r"\bCH\d+\b"))
    return (F.length(context) >= 500) & ~((labels >= 3) & (F.length(context) < 1000)) & ~strip(topic).rlike(r"(?i)^CH\d+(?:-CH\d+)?$")


def question_key(c: Column) -> Column:
    return F.lower(strip(squeeze(c)))


def distinct_questions(rows: DataFrame, order: str) -> DataFrame:
    """The first question of each normal form; (key, order)."""
    return rows.select(question_key(F.col("question")).alias("key"), order).groupBy("key").agg(F.min(order).alias(order))


def graded(answers: DataFrame, key: str) -> DataFrame:
    """(key, correct, wrong, accuracy) of rows with answer and given."""
    right = F.col("answer").eqNullSafe(F.col("given"))
    return answers.groupBy(key).agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong"), F.avg(right.cast("double")).alias("accuracy"))


# Generation: topics by seed, contexts in one plan, then one call after the other.

QUESTION_SHAPE = '{"question": "...", "options": {"A": "...", "B": "...", "C": "...", "D": "..."}, "answer": "A", "explanation": [{"text": "...", "sources": ["[1]"]}]}'
#: What a question writer is told, by language; the answer has to have QUESTION_SHAPE.
WRITER = {
    "cn": "你負責出題，只能使用 CONTEXT 的內容。出一題四選一的單選題，選項為 A、B、C、D，正確答案只有一個。解析是清單，每一項都附 sources（只能用 [1] 到 [k]），並含一段以雙引號標出、逐字見於 CONTEXT 的引文。做不到時只輸出 NOT_FOUND，否則只輸出這個格式的 JSON：",
    "en": "You write exam questions from the CONTEXT alone. Write one question with four options A, B, C and D, one of them right. The explanation is a list; each item cites sources (only [1] to [k]) and quotes the CONTEXT word for word in double quotes. If that cannot be done, print NOT_FOUND only, else only JSON of this form: ",
}
BARE_CHAPTER = re.compile(r"CH\d+(?:-CH\d+)?", re.I)
TAG = re.compile(r"\[\d+\]")


def drawn(pool: list[str], n: int, seed: int = 7) -> list[str]:
    """The topics of up to 3 n attempts, drawn with replacement; bare chapter names use up their attempt."""
    source = random.Random(seed)
    return [t for t in (source.choice(pool) for _ in range(3 * n)) if not BARE_CHAPTER.fullmatch(t.strip())]


def contexts(index: DataFrame, asked: DataFrame, embedder, k: int = 5, max_chars: int = 6000, per_hit: int = 1200) -> DataFrame:
    """(query_id, context, sources) of topics (query_id, query): the nearest k pages, with a map from tag to source. Contexts that are too short or mere lists of chapters are left out."""
    from ..providers import embedded
    from . import search

    vectors = asked.select("query_id", embedded(F.col("query"), embedder).alias("vector"))
    near = search.vector_search_batch(index.where("embedding IS NOT NULL"), vectors, k, None).join(index.select("pos", "doc_id", "page", "text", "ocr", "images"), "pos")
    packed = search.packed_exam_context(near.select("query_id", "rank", "score", "doc_id", "page", "text", "ocr"), max_chars, per_hit)
    snippet = F.left(squeeze(strip(F.concat(F.coalesce("ocr", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))), F.lit(per_hit))
    source = F.struct(F.coalesce("doc_id", F.lit("unknown")).alias("doc_id"), "page", F.get("images", 0).alias("image"), "images", snippet.alias("snippet"), F.col("score").cast("double").alias("score"))
    listed = near.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")), source))).alias("known"))
    rows = packed.join(listed, "query_id").join(asked, "query_id").where(context_ok(F.col("context"), F.col("query")))
    return rows.select("query_id", "context", restricted(F.col("known"), F.col("sources")).alias("sources"))


def parsed_question(text: str, context: str, sources: dict, strict_quote: bool = False) -> dict | None:
    """The question in a model's answer, with the sources it uses; null if it is not fit."""
    blob = text[text.find("{") : text.rfind("}") + 1]
    try:
        found = json.loads(blob)
    except ValueError:
        return None
    if not isinstance(found, dict) or not fit_question(found):
        return None
    explained = [e for e in found["explanation"] if isinstance(e, dict)]
    quotes = [q for e in explained for q in re.findall(r'"([^"]{3,120})"', str(e.get("text") or ""))]
    if strict_quote and not any(q in context for q in quotes):
        return None
    used = list(dict.fromkeys(s for e in explained for s in e.get("sources") or [] if isinstance(s, str) and TAG.fullmatch(s)))
    cited = {s: sources[s] for s in used if s in sources}
    return found | {"sources_used": used, "sources_map": cited} if cited else None


def fit_question(found: dict) -> bool:
    """valid_question for one decoded question."""
    question, options, answer, explanation = (found.get(k) for k in ("question", "options", "answer", "explanation"))
    if not isinstance(options, dict) or not isinstance(explanation, list) or not explanation:
        return False
    stem_ok = not re.search(r"\n\s*[ABCD][).]|\b[ABCD][).]\s", str(question or ""))
    filled = all(str(options.get(k) or "").strip() not in ("", "NOT_FOUND") and not TAG.fullmatch(str(options[k]).strip()) for k in "ABCD")
    sourced = all(isinstance(e, dict) and isinstance(e.get("sources"), list) and e["sources"] for e in explanation)
    return stem_ok and filled and sourced and str(answer or "").strip() in ("A", "B", "C", "D")


def written_question(topic: str, context: str, sources: dict, model, lang: str = "auto", strict_quote: bool = False, retries: int = 2) -> dict | None:
    """Asks the model for a question until one is fit, at most retries + 1 times; NOT_FOUND ends at once."""
    chinese = lang == "cn" or lang == "auto" and re.search("[一-鿿]", topic + " " + context[:500])
    system = WRITER["cn" if chinese else "en"] + QUESTION_SHAPE
    user = f"{'主題：' if chinese else 'TOPIC: '}{topic}\n\nCONTEXT:\n{context}"
    for _ in range(retries + 1):
        said = model.complete(system, user, 1024)
        if said.strip() == "NOT_FOUND":
            return None
        if question := parsed_question(said, context, sources, strict_quote):
            return question
    return None


def generated(index: DataFrame, model, embedder, n: int = 10, k: int = 5, max_chars: int = 6000, per_hit: int = 1200, lang: str = "auto", strict_quote: bool = False, seed: int = 7, chapter: str = "") -> list[dict]:
    """Up to n questions over an index, none twice. The contexts of all attempts come from one plan; at most 3 n are brought to the driver."""
    spark = index.sparkSession
    pool = [r.topic for r in topics(index).collect()] or [chapter]  # at most 300
    attempts = drawn(pool, n, seed)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(dict.fromkeys(attempts))], "query_id long, query string")
    number = {t: k for k, t in enumerate(dict.fromkeys(attempts))}
    found = {r.query_id: r for r in contexts(index, asked, embedder, k, max_chars, per_hit).collect()}
    out, seen = [], set()
    for topic in attempts:
        if len(out) >= n:
            break
        row = found.get(number[topic])
        sources = {tag: s.asDict() for tag, s in row.sources.items()} if row else {}
        question = written_question(topic, row.context, sources, model, lang, strict_quote) if row else None
        key = " ".join(str(question["question"]).split()).lower() if question else None
        if question is None or key in seen:
            continue
        seen.add(key)
        out.append(question | {"id": f"Q{len(out) + 1:04d}", "type": "mcq", "topic": topic})
    if not out:
        raise ValueError(f"no question could be made of {chapter or 'the index'} in {len(attempts)} attempts")
    return out
