"""Text expressions over columns. All stay in the JVM but nfkc(), which is an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
CJK_PLAIN = "[\u4e00-\u9fff]"
#: Marks a page without text at the compatible sinks; inside, such a text is null.
NO_TEXT = "這頁是沒有txt的"

# Fillers that a search query is cleaned of, in the order in which they are replaced.
QUERY_FILLERS = ["請", "幫我", "整理", "介紹", "說明", "解釋", "列出", "比較", "並附頁碼", "附上頁碼", "附頁碼", "頁碼", "的相關概念", "相關概念", "相關內容", "內容", "考前重點", "找不到請標示未找到", "找不到", "請用表格", "並", "和", "與"]
# Fillers that the topic of a question is cleaned of, in order.
TOPIC_FILLERS = ["請", "幫我", "詳細介紹", "介紹", "說明", "解釋", "整理", "列出", "流程步驟", "流程", "步驟", "越詳細越好", "越詳細", "最好", "加上", "步驟說明", "的", "一下", "一下子", "，", ",", "。", "？", "?", "！", "!"]
# Words that tell the kind of a question, by falling priority.
TASK_WORDS = {"process": ["流程", "步驟"], "compare": ["比較", "差異", "不同"], "summary": ["整理", "重點", "考前", "列出"]}
# What a step question's topic is followed by in its search, by language.
SEARCH_SUFFIXES = {"cn": " 相關概念 技術 主題 章節", "en": " related concepts techniques topics chapters"}
# Shapes of whole noise lines, of dense codes, and of what is cut out of lines.
NOISE_CODES = [r"^\d+[-_]{2,}\d+$", r"^(?:\d+-\d+\s*)+$", r"(R\d){3,}"]
DENSE_LINE = r"^[A-Za-z0-9\-\s]+$"
CUT_FROM_LINES = [r"(R\d){3,}[\w\-]*", r"\b\d{3}[-_]{3}\d{3}\b"]
# Line shapes of extraction noise.
NOISE_LINES = [r"^R\d+i-g\d+ht-\d+$", r"^(Icon-\d+\s*)+$", r"^第\d+頁$", r"^S\d+u-\d+bNo\b.*$", r"^SubNo\b.*$", r"^SubName\b.*$", r"^(?:R\d[\w\-]*\s*){3,}$", r"^[\-\_\|\=\s]{8,}$"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space of any length becomes one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals as printf has it, by its exact value and halves to even; format_string rounds the shortest decimal, halves up."""
    return F.coalesce(F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)), F.lit("null"))


def nfkc(c: Column) -> Column:
    """A batch of texts is bounded in bytes, and of it only a few that are not ASCII are Python's own strings at a time."""
    if session := SparkSession.getActiveSession():
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return composed(texts)

    return compose(c)


def composed(texts: pa.Array, rows: int = 64) -> pa.Array:
    """NFKC, so many rows at a time; ASCII is stable under it."""
    parts = []
    for at in range(0, len(texts), rows):
        part = texts.slice(at, rows)
        plain = pc.all(pc.string_is_ascii(part), min_count=0).as_py()
        parts.append(part if plain else pa.array((None if x is None else unicodedata.normalize("NFKC", x) for x in part.to_pylist()), part.type))
    return pa.concat_arrays(parts) if parts else texts


def normalized(c: Column, compose: bool = True) -> Column:
    """NFKC, lower case, no white space. compose=False skips NFKC, for text that is known to be stable under it."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(nfkc(c) if compose else c), r"(?U)\s+", "")


def distinct_forms(c: Column) -> Column:
    """The strings of an array whose normal form is not empty and new, in order."""

    def firsts(texts) -> list[str]:
        found: dict[str, str] = {}
        for t in texts:
            found.setdefault(normalized_text(t), t)
        found.pop("", None)
        return list(found.values())

    @F.pandas_udf("array<string>")
    def distinct(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: None if texts is None else firsts(texts))

    return distinct(c)


def normalized_text(s: str | None) -> str:
    """The same for one string on the driver."""
    return "".join(unicodedata.normalize("NFKC", s or "").lower().split())


def replaced(c: Column, words: list[str]) -> Column:
    for w in words:
        c = F.replace(c, F.lit(w), F.lit(" "))
    return c


def query_variants(c: Column) -> Column:
    """The query and the parts that its separators leave after fillers are gone; trimmed, distinct by normal form, first ones kept."""
    parts = F.split(replaced(c, QUERY_FILLERS), r"[，,。；;：:\n\r\t]+")
    every = F.filter(F.transform(F.concat(F.array(c), parts), strip), lambda v: v != "")
    return distinct_forms(every)


def task_type(c: Column) -> Column:
    out = F.lit("qa")
    for name, words in reversed(TASK_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return F.when(c.isNull(), "qa").otherwise(out)


def answer_tokens(task: Column) -> Column:
    """How many tokens an answer may take."""
    return F.when(task == "process", 768).when(task.isin("summary", "compare"), 640).otherwise(384)


def search_depth(task: Column, k: Column) -> Column:
    return F.least(k, F.when(task == "process", 30).when(task.isin("summary", "compare"), 25).otherwise(15))


def main_topic(c: Column) -> Column:
    topic = strip(squeeze(replaced(c, TOPIC_FILLERS)))
    return filled(topic, c)


def retrieval_query(c: Column) -> Column:
    suffix = F.when(c.rlike(CJK), SEARCH_SUFFIXES["cn"]).otherwise(SEARCH_SUFFIXES["en"])
    return F.when(task_type(c) == "process", F.concat(main_topic(c), suffix)).otherwise(c)


def is_noise(line: Column) -> Column:
    """Lines of codes and separators, without CJK."""
    s = strip(line)
    dense = F.replace(s, F.lit(" "), F.lit(""))
    ratio = F.size(F.array_distinct(F.split(dense, ""))) / F.greatest(F.lit(1), F.length(dense))
    return (
        F.when(s == "", False)
        .when(s.rlike(CJK), False)
        .when(s.rlike("|".join(NOISE_CODES)), True)
        .when(F.length(s) < 10, False)
        .when(s.rlike(DENSE_LINE) & (ratio < 0.35), True)
        .otherwise(F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))) >= 3)
    )


def is_dropped_line(line: Column) -> Column:
    s = strip(line)
    hit = (s == "") | is_noise(s)
    for p in NOISE_LINES:
        hit = hit | s.rlike(p)
    return hit


def cleaned_text(c: Column) -> Column:
    """A page's text without extraction noise, line by line."""
    lines = F.transform(F.split(c, r"\R"), lambda x: strip(F.regexp_replace(x, r"(?U)\s{2,}", " ")))
    for shape in CUT_FROM_LINES:
        lines = F.transform(lines, lambda x: F.regexp_replace(x, shape, ""))  # noqa: B023
    return strip(F.array_join(F.filter(lines, lambda x: ~is_dropped_line(x) & ~x.rlike(r"^\d+$") & (x != "")), "\n"))


def index_text(text: Column, ocr: Column) -> Column:
    """What is embedded and searched: text and OCR with a blank line between them, without empty ones and the no-text mark."""
    return F.concat_ws("\n\n", F.when(~strip(text).isin("", NO_TEXT), strip(text)), F.when(strip(ocr) != "", strip(ocr)))


def usable_answer(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return (s != "") & ~F.startswith(F.lower(s), F.lit("sources:")) & (F.length(s) >= 10)


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n))), F.lit("..."))).otherwise(F.rtrim(c))


def evidence(c: Column, term: Column, around: int = 60) -> Column:
    """The surroundings of the term's first place, or the beginning."""
    blob = squeeze(strip(c))
    at = F.locate(term, blob) if isinstance(term, str) else F.instr(blob, term)
    start = F.greatest(at - 1 - around, F.lit(0))
    near = F.substring(blob, start + 1, F.least(F.length(blob), at - 1 + around) - start)
    return F.when((at > 0) & (term != ""), near).otherwise(F.left(blob, F.lit(2 * around)))


def chunks(c: Column, size: int, most: int) -> Column:
    c = F.coalesce(c, F.lit(""))
    if size <= 0:
        return F.array(c)
    n = F.ceil(F.length(c) / size).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, lambda i: F.substring(c, i * size + 1, F.lit(size)))


def sanitized(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_"), r"^_+|_+$", "")


def first_json(c: Column) -> Column:
    """The widest {...} of a text if it parses, else null."""
    blob = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when((blob != "") & F.try_parse_json(blob).isNotNull(), blob)


def keep_ids(c: Column, n: int | Column, k: int) -> Column:
    """The numbers after KEEP:, those from 0 to below n, distinct, at most k."""
    listed = F.regexp_extract(c, r"(?i)KEEP\s*:\s*([0-9,\s]+)", 1)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: x < n)), 1, k)


def listed_terms(c: Column) -> Column:
    """The terms of a model's answer: its lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), strip), lambda t: t != "")


def has_effective_text(content: Column) -> Column:
    """Does a page-text file hold more than page headers and no-text marks?"""
    bare = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?im)^=+\s*Page\s+\d+\s*=+$", "")
    return strip(F.replace(bare, F.lit(NO_TEXT), F.lit(""))) != ""


def joined_text(c: Column) -> Column:
    """A list of texts as one text, by lines; null is empty."""
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n", "None")


def static_url(path: Column) -> Column:
    """The address of a file under the data folder, percent-encoded but for what addresses may hold."""
    coded = F.url_encode(path)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("%28", "("), ("%29", ")"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.concat(F.lit("/static/"), coded)


def relative_path(path: Column, root: str) -> Column:
    """path below root; paths elsewhere stay as they are, null is empty."""
    plain = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.length(plain))).otherwise(plain)
