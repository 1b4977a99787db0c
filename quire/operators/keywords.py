"""Keyword mining: terms, frequencies, scores, metrics and selection.

Terms are extracted page by page in Arrow batches and counted per chapter, first
within a task, so each count is combined before its shuffle; scores and ranks are DataFrame
operations. A chapter may hold most rows, so its ranks and percentiles are counted
over ranges of its order. The order-dependent choice among overlapping terms is a
fold over windows of ranks, whose state is stored from one window to the next.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, CJK_PLAIN, squeeze, strip
from ..sources.scratch import kept
from .numbering import running

# Words that are no keywords.
STOP_CN = "例如 可以 定義 表示 如下 其中 因此 我們 你們 以及 進行 使用 工作 目標 系統 資料 結果 問題 相關 圖形 程式 大致 分成下列幾種 應用 好的 一下 個英文字母 假設事件 顧名思義 比較 進入 開始 假設 設定 如圖 這頁是沒有 首先 下列 形成下列 包含下列 被應用在 可應用在 可用於 用於 用在 總共 都是 直接".split()
STOP_EN = "the and with from that this into used using int void main char double float bool return include std cout cin printf println true false null none class public private input output width height size type value range rate bits pixel point data test modern until rest stay side given large often areas count".split()
STOP_TERMS = "img inter main array filename opencv fontface roi".split()
FORMAT_NOISE = "www http https uri url com net org edu gov io pdf ppt pptx doc docx xls xlsx csv json jsonl md txt jpeg jpg png gif bmp tiff svg".split()
# Parts of boilerplate terms.
BOILERPLATE = ["圖片裡沒文字", "這頁是沒有txt的", "這頁是沒有", "沒有抓到", "跳過", "SKIP", "DONE", "ERROR", "WARN"]
# Shapes of fragments, each with the longest term that it rejects (0: any).
JUNK_SHAPES = [
    (r"://|/|\\", 0),
    (r"^[\d\W_]+$", 0),
    (r"(?i)(ing|ed|tion|ness|ment)$", 4),
    (r"[態能值例序構法]$", 4),
    (r"^(?:即|若|則|因此|所以|可以|用來|用於|進入|開始|總共|首先|接著|然後)", 0),
    (r"(型態|能力|序列|元素|範例)$", 6),
    (r"(分為下列|包含下列|如下|如圖|舉例|例如|可以|用於|用來|透過|通過|因此|所以|若|則)", 8),
    (r"(約落在|大約|落在|介於)", 0),
    (r"^(?:其|此|該|本|各|每|某|若|則|較|更|最|可|會|將|已|未|在|由|對|於|以|而|及|與|或|之|的)", 6),
    (r"(?:包含|步驟|容易|可能|因此|所以|等等|如下)$", 6),
    (r"^(?:出|個|其|此)[\x{4e00}-\x{9fff}]{2,}$", 8),
]
# Shapes of Chinese phrases that are no terms.
CN_EDGES = r"^(?:的|是|為|於|而|中|以|等|上|下|若|當|年|已)|(?:的|是|為|於|而|中|以|等|上|下|個|由)$"
CN_PHRASES = r"稱為|如下|例如|簡述|舉例|可以|用來|主要|進行|結果|根據|表示|包含下列|形成下列|則形成|下列幾|被應用在|可應用在|可用於|用於|用在"
CN_VERB_ENDS = r"(成|為|得|進行|使用|轉換|形成|開始|進入)$"
# Roman numerals as words.
ROMAN_WORD = r"^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
# The three passes over English text: capitals, phrases in title case, words in lower case.
EN_PASSES = [r"\b[A-Z]{2,8}\b", r"\b(?:[A-Z][a-z]{2,}\s){1,4}[A-Z][a-z]{2,}\b", r"\b[a-z]{3,}\b"]
#: The same passes, each beginning with a letter, which Python's search can skip to.
_FAST_PASSES = [r"[A-Z](?<!\w[A-Z])[A-Z]{1,7}\b", r"[A-Z](?<!\w[A-Z])[a-z]{2,}\s(?:[A-Z][a-z]{2,}\s){0,3}[A-Z][a-z]{2,}\b", r"[a-z](?<!\w[a-z])[a-z]{2,}\b"]


def is_stop(t: Column) -> Column:
    low = F.lower(strip(t))
    tail = F.regexp_extract(low, r"\.([^.]*)$", 1)
    return (low == "") | low.isin(STOP_TERMS + FORMAT_NOISE) | tail.isin(FORMAT_NOISE) | low.rlike(r"://|/|\\") | low.rlike(r"(?U)^[\d\W_]+$") | low.rlike("^[a-z]{1,2}$")


def is_junk(t: Column) -> Column:
    t = strip(t)
    n, dense = F.length(t), F.regexp_replace(t, r"(?U)\s+", "")
    hit = n <= 2
    for b in BOILERPLATE:
        hit = hit | F.contains(t, F.lit(b))
    hit = hit | ((F.length(dense) >= 8) & (F.size(F.array_distinct(F.split(dense, ""))) / F.greatest(F.length(dense), F.lit(1)) < 0.35))
    for shape, longest in JUNK_SHAPES:
        shape = shape if "(?i)" in shape else f"(?U){shape}"
        hit = hit | (t.rlike(shape) & (n <= longest) if longest else t.rlike(shape))
    return hit


def terms(text: Column, lang: str = "en") -> Column:
    """What the passes find in a text, in order of extraction; overlaps count each. is_term() tells the terms among it."""
    if lang == "cn":
        return F.regexp_extract_all(text, F.lit(rf"({CJK}{{2,8}})"), F.lit(1))
    capitals, titles, words = (F.regexp_extract_all(F.lower(text) if k == 2 else text, F.lit(f"({p})"), F.lit(1)) for k, p in enumerate(EN_PASSES))
    every = F.concat(capitals, titles, words)
    return every


def is_term(t: Column, lang: str = "en") -> Column:
    if lang == "cn":
        return ~is_junk(t) & ~is_stop(t)
    # the English passes give lower-case letters and single spaces, so only these rules of is_junk and is_stop can apply
    n, dense = F.length(t), F.replace(t, F.lit(" "), F.lit(""))
    dull = (F.length(dense) >= 8) & (F.size(F.array_distinct(F.split(dense, ""))) / F.greatest(F.length(dense), F.lit(1)) < 0.35)
    return (n > 2) & ~t.isin(STOP_TERMS + FORMAT_NOISE) & ~((n <= 4) & t.rlike("(ing|ed|tion|ness|ment)$")) & ~t.rlike(ROMAN_WORD) & ~dull


def _listing(lang: str) -> Callable[[str], list[str]]:
    """What the passes find in a text, in order of extraction; of the English ones, those over capitals and titles."""
    if lang == "cn":
        return re.compile(f"{CJK_PLAIN}{{2,8}}").findall
    capitals, titles = (re.compile(p).findall for p in _FAST_PASSES[:2])
    return lambda text: [t.lower() for t in capitals(text)] + [" ".join(t.lower().split()) for t in titles(text)]


#: Characters of pages that a task looks at together, or those of one page.
CHARS_AT_ONCE = 1 << 20


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(doc_id, pos, head, blob) of pages, some at a time."""
    some: list[tuple] = []
    chars = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for doc_id, pos, text, ocr in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                some.append((doc_id, pos, (text or "")[:80].lower(), f"{text or ''}\n{ocr or ''}"))
                chars += len(some[-1][3])
                if chars >= CHARS_AT_ONCE:
                    yield some
                    some, chars = [], 0
    if some:
        yield some


def _given(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc_id").cast("string"), F.col("pos").cast("long"), "text", "ocr")


def page_terms(pages: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, pos, term, hits, place, heading): per page and term; place is the first in order of extraction, heading: is it in the page's first 80 characters?

    Terms are counted within a page before they become rows, so that a term costs a row per page and not per occurrence.
    """
    listed, words = _listing(lang), re.compile(_FAST_PASSES[2]).findall
    stops = frozenset(STOP_CN if lang == "cn" else STOP_EN)
    schema = pa.schema([("doc_id", pa.string()), ("pos", pa.int64()), ("term", pa.string()), ("hits", pa.int64()), ("place", pa.int32()), ("heading", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pages(batches):
            out: list[tuple] = []
            for doc_id, pos, head, blob in some:
                found = listed(blob) + (words(blob.lower()) if lang != "cn" else [])
                first: dict[str, int] = {}
                for n, t in enumerate(found):
                    first.setdefault(t, n)
                out += [(doc_id, pos, t, n, first[t], t in head) for t, n in Counter(found).items() if t not in stops]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return _given(pages).mapInArrow(run, "doc_id string, pos long, term string, hits long, place int, heading boolean")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The third English pass over texts in lower case: its words, one text after the other, and how many each text has."""
    chars = _points("".join(f"{t}\n" for t in texts))
    letter = chars - np.uint32(ord("a")) < 26  # what is below goes round
    word = letter | (chars - np.uint32(ord("0")) < 10) | (chars == ord("_")) | (chars - np.uint32(ord("A")) < 26)
    if len(far := np.flatnonzero(chars > 127)):
        kinds, which = np.unique(chars[far], return_inverse=True)
        word[far] = np.array([chr(k).isalnum() for k in kinds.tolist()])[which]
    edges = np.flatnonzero(np.diff(word, prepend=False))  # the last character is none of a word
    start, end = edges[::2], edges[1::2]
    plain = end - start >= 3
    plain[np.searchsorted(start, np.flatnonzero(word & ~letter), "right") - 1] = False
    start, end = start[plain], end[plain]
    inside = np.zeros(len(chars), np.int8)
    inside[start], inside[end] = 1, -1  # words do not touch
    data, offsets = chars[np.cumsum(inside, dtype=np.int8).astype(bool)].astype(np.uint8), np.append(0, np.cumsum(end - start)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    return found, np.diff(np.searchsorted(start, bounds))


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(sorted_keys)])


def _in_heads(names: list[str], heads: list[str], code: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Is names[code] in heads[page]? Only looked at where the head has the name's first and last two characters."""
    mixed = lambda a, b: (a * np.uint32(61) + b) & np.uint32(4095)
    chars, ends = _points("".join(f"{h}\n" for h in heads)), np.cumsum([len(h) + 1 for h in heads])
    seen = np.zeros((len(heads), 4096), bool)
    seen[np.repeat(np.arange(len(heads)), np.diff(ends, prepend=0))[:-1], mixed(chars[:-1], chars[1:])] = True
    chars, ends = _points("".join(names)), np.cumsum([len(t) for t in names])  # of two characters at least
    begin = np.append(0, ends[:-1])
    may = np.flatnonzero(seen[page, mixed(chars[begin], chars[begin + 1])[code]] & seen[page, mixed(chars[ends - 2], chars[ends - 1])[code]])
    found = np.zeros(len(code), np.int64)
    found[may] = [names[c] in heads[p] for c, p in zip(code[may].tolist(), page[may].tolist(), strict=True)]
    return found


#: Found terms that a task counts at a time, or those of CHARS_AT_ONCE.
FOUND_AT_ONCE = 1 << 21
_PARTS = pa.schema([("doc_id", pa.string()), ("term", pa.string()), ("tf", pa.int64()), ("page_df", pa.int64()), ("headings", pa.int64()), ("pos", pa.int64()), ("place", pa.int32()), ("rep_pos", pa.int64()), ("rep_hits", pa.int64())])


def _part(pages: list[tuple], listed: list[pa.Array], n_listed: np.ndarray, words: list[pa.Array], n_words: np.ndarray, stops: frozenset[str]) -> pa.RecordBatch:
    """Counts per chapter and term of pages (doc_id, pos, head), of which first what is listed stands one page after the other, then the words."""
    coded = pa.concat_arrays([*listed, *words]).dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if not names:
        return pa.RecordBatch.from_pylist([], _PARTS)
    # per page and term; all stands in order of extraction, so the first one tells the place
    key = np.concatenate([np.repeat(np.arange(len(pages)), n) for n in (n_listed, n_words)]) * len(names) + code
    order = np.argsort(key, kind="stable")
    start = _runs(key[order])
    at, hits = order[start], np.diff(np.append(start, len(order)))
    page, code = np.divmod(key[at], len(names))
    stays = ~np.array([t in stops for t in names])[code]
    page, code, hits, at = page[stays], code[stays], hits[stays], at[stays]
    place = np.where(at < n_listed.sum(), at - (np.cumsum(n_listed) - n_listed)[page], at - n_listed.sum() - (np.cumsum(n_words) - n_words - n_listed)[page])
    heading = _in_heads(names, [head for *_, head in pages], code, page)
    # per chapter and term; pages without a position are apart, as they cannot be the first
    number: dict[tuple, int] = {}
    key = np.array([number.setdefault((doc_id, pos is None), len(number)) for doc_id, pos, _ in pages], np.int64)[page] * len(names) + code
    pos = np.array([0 if pos is None else pos for _, pos, _ in pages], np.int64)[page]
    order = np.argsort(key, kind="stable")
    key, pos, hits, place = key[order], pos[order], hits[order], place[order]
    start = _runs(key)
    if not len(start):
        return pa.RecordBatch.from_pylist([], _PARTS)
    page_df, last = np.diff(np.append(start, len(key))), np.iinfo(np.int64).max
    least, most = np.minimum.reduceat(pos, start), np.maximum.reduceat(hits, start)
    first = np.minimum.reduceat(np.where(pos == np.repeat(least, page_df), place, last), start)
    best = np.minimum.reduceat(np.where(hits == np.repeat(most, page_df), pos, last), start)
    chapter, code = np.divmod(key[start], len(names))
    unplaced = np.array([none for _, none in number])[chapter]
    columns = [
        pa.array([doc_id for doc_id, _ in number], pa.string()).take(pa.array(chapter)), coded.dictionary.take(pa.array(code)), pa.array(np.add.reduceat(hits, start)), pa.array(page_df), pa.array(np.add.reduceat(heading[order], start)),
        pa.array(least, mask=unplaced), pa.array(first.astype(np.int32), mask=unplaced), pa.array(best, mask=unplaced), pa.array(most),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTS)


def counted(pages: DataFrame, lang: str = "en") -> DataFrame:
    """term_counts of page_terms; a task combines what its pages of a chapter have in common, as columns of numbers, before it becomes rows."""
    listing = _listing(lang)
    stops = frozenset(STOP_CN if lang == "cn" else STOP_EN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        parts: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            listed, n_listed, words, n_words = zip(*parts, strict=True)
            return _part(held, [*listed], np.concatenate(n_listed), [*words], np.concatenate(n_words), stops)

        for some in _pages(batches):
            blobs = [blob for *_, blob in some]
            found = [listing(blob) for blob in blobs]
            words, n_words = _words([blob.lower() for blob in blobs]) if lang != "cn" else (pa.array([], pa.string()), np.zeros(len(blobs), np.int64))
            held += [page[:3] for page in some]
            parts.append((pa.array([t for terms in found for t in terms], pa.string()), np.array([len(terms) for terms in found], np.int64), words, n_words))
            n += len(parts[-1][0]) + len(words)
            if n >= FOUND_AT_ONCE:
                yield flush()
                held, parts, n = [], [], 0
        if held:
            yield flush()

    # a task that has pages of one chapter or few finds the same terms again; a large chapter goes to several tasks.
    # The number is given, as tasks are long for their bytes and would be coalesced to too few.
    n_tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _given(pages).repartitionByRange(n_tasks, "doc_id", "pos").mapInArrow(run, "doc_id string, term string, tf long, page_df long, headings long, pos long, place int, rep_pos long, rep_hits long")
    return _summed(rows, lang)


def term_counts(counted: DataFrame, lang: str = "en") -> DataFrame:
    """Per chapter and term: tf, page_df, heading (0 to 1), first (page and place), and the page with the most hits."""
    one = F.lit(1).cast("long")
    return _summed(counted.select("doc_id", "term", F.col("hits").alias("tf"), one.alias("page_df"), F.col("heading").cast("long").alias("headings"), "pos", "place", F.col("pos").alias("rep_pos"), F.col("hits").alias("rep_hits")), lang)


def _summed(parts: DataFrame, lang: str) -> DataFrame:
    """What is no term goes here, after counting, so that each shape is tested once per chapter and not at every occurrence.

    Pairs go through min and max as one number each, which a hash aggregate can hold; structs would make it sort. That number
    is a long where both parts have room in it, else a decimal, which is slow.
    """
    wide, turn, step = (lambda c: F.col(c).cast("decimal(38,0)")), F.lit(1 << 31).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    low = F.lit((1 << 32) - 1)
    near, near_rep = F.col("pos").between(0, low), F.col("rep_pos").between(0, low) & (F.col("rep_hits") < 1 << 31)
    counts = parts.groupBy("doc_id", "term").agg(
        F.sum("tf").alias("tf"), F.sum("page_df").alias("page_df"), F.least(F.lit(1.0), F.sum("headings") * 0.5).alias("heading"), F.max("rep_hits").alias("rep_hits"),
        F.min(F.when(near, F.shiftleft("pos", 31).bitwiseOR(F.col("place").cast("long")))).alias("at"), F.min(F.when(~near, (wide("pos") * turn + wide("place")).cast("decimal(38,0)"))).alias("far_at"),
        F.max(F.when(near_rep, F.shiftleft("rep_hits", 32).bitwiseOR(low - F.col("rep_pos")))).alias("top"), F.max(F.when(~near_rep, (wide("rep_hits") * step - wide("rep_pos")).cast("decimal(38,0)"))).alias("far_top"),
    )
    pair = lambda known, pos, place: F.when(F.col(known).isNotNull(), F.struct(pos.cast("long").alias("pos"), place.cast("int").alias("place")))
    first = F.least(pair("at", F.shiftright("at", 31), F.col("at").bitwiseAND(F.lit((1 << 31) - 1))), pair("far_at", F.floor(F.col("far_at") / turn), F.pmod("far_at", turn)))
    first = F.coalesce(first, F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("int").alias("place")))
    # a page with fewer hits than rep_hits gives no position, or one that is no long
    rep = F.least(F.when(F.shiftright("top", 32) == F.col("rep_hits"), low - F.col("top").bitwiseAND(low)), F.when(F.col("far_top").isNotNull(), (wide("rep_hits") * step - F.col("far_top")).try_cast("long")))
    counts = counts.withColumns({"first": first, "rep_pos": rep}).select("doc_id", "term", "tf", "page_df", "heading", "rep_hits", "first", "rep_pos")
    return counts.where(is_term(F.col("term"), lang))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def scored(pages: DataFrame, counts: DataFrame, lang: str = "en") -> DataFrame:
    """Adds df, idf, coverage and raw_score, and leaves out what is no term of the language."""
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_in_doc"))
    return scored_counts(counts.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))), sizes, lang)  # a row for each chapter


def scored_counts(counts: DataFrame, sizes: DataFrame, lang: str = "en") -> DataFrame:
    """scored, from counts with their df and the chapters (doc_id, pages_in_doc)."""
    corpus = sizes.agg(F.count(F.lit(1)).alias("n_docs"))
    rows = counts.join(sizes, "doc_id").crossJoin(F.broadcast(corpus))  # one row
    n, df, tf = F.col("n_docs"), F.col("df"), F.col("tf")
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    coverage = F.col("page_df") / F.col("pages_in_doc")
    penalty = F.pow(F.greatest(F.lit(1e-6), 1.0 - df / n), F.lit(1.5))
    raw = (0.55 * idf + 0.35 * coverage + 0.10 * F.col("heading")) * (tf / (tf + 3.0)) * penalty * F.when(F.length("term") >= 7, 0.5).otherwise(1.0)
    rows = rows.withColumns({"idf": idf, "coverage": coverage, "raw_score": raw}).where("raw_score > 0")
    cjk, t = F.col("term").rlike(CJK), F.col("term")
    if lang != "cn":
        return rows.where(~cjk)
    short = F.length(t)
    bad = t.rlike(CN_EDGES) | t.rlike(CN_PHRASES) | t.rlike(CN_VERB_ENDS) | ((short <= 3) & t.rlike("[的之於]")) | ((short <= 2) & (tf <= 2)) | ((short <= 6) & t.rlike("[而則於以]"))
    return rows.where(cjk & ~bad)


def _order() -> list[Column]:
    return [F.desc(F.round("raw_score", 9)), F.col("first.pos").asc(), F.col("first.place").asc()]


def ranked(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Adds rank by score, ties by first place; n: the best only, which Spark takes from each task before its shuffle."""
    if n:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*_order()))).where(F.col("rank") <= n)
    return running(rows, "doc_id", _order()).withColumn("rank", F.col("rank").cast("int"))


def with_norm(rows: DataFrame) -> DataFrame:
    """Adds score_norm, in percent of the chapter's best."""
    best = rows.groupBy("doc_id").agg(F.max("raw_score").alias("best"))
    return rows.join(best, "doc_id").withColumn("score_norm", 100.0 * F.col("raw_score") / F.when(F.col("best") == 0, 1.0).otherwise(F.col("best"))).drop("best")


def percentiles(values: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """(doc_id, p): the exact percentiles of each chapter, as percentile() has them, from the counts `n` of its distinct values.

    Only the values at the places asked for leave the range that they stand in, two for each fraction.
    """
    counted = running(values, "doc_id", [F.col(column)], "upto", "n")
    total = values.groupBy("doc_id").agg(F.sum("n").alias("total"))
    place = lambda f: F.lit(f) * (F.col("total") - 1)
    asked = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(place(f)) if up else F.floor(place(f))).cast("long").alias("at")) for k, f in enumerate(fractions) for up in (False, True)))
    rows = counted.join(total, "doc_id")
    hits = rows.select("doc_id", "total", column, F.explode(F.filter(asked, lambda x: (x["at"] < F.col("upto")) & (x["at"] >= F.col("upto") - F.col("n")))).alias("a"))
    ends = hits.groupBy("doc_id").agg(F.first("total").alias("total"), *(F.max(F.when((F.col("a.k") == k) & (F.col("a.up") == F.lit(up)), F.col(column))).alias(f"v{k}{int(up)}") for k in range(len(fractions)) for up in (False, True)))
    between = [F.when(F.col(f"v{k}0") == F.col(f"v{k}1"), F.col(f"v{k}0")).otherwise((F.ceil(place(f)) - place(f)) * F.col(f"v{k}0") + (place(f) - F.floor(place(f))) * F.col(f"v{k}1")) for k, f in enumerate(fractions)]
    return ends.select("doc_id", F.array(*between).alias("p"))


def metrics(rows: DataFrame, stored: bool = False) -> DataFrame:
    """How the scores of each chapter are spread. rows are read more than once, so what is needed of them is written first, unless they are stored."""
    rows = rows.select("doc_id", "raw_score", "first")
    rows = rows if stored else kept(rows, "spread")
    values = kept(rows.groupBy("doc_id", "raw_score").agg(F.count(F.lit(1)).alias("n")), "values")
    spread = values.groupBy("doc_id").agg((F.sum(F.col("raw_score") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n_terms"))
    head = ranked(rows, 100).groupBy("doc_id").agg(F.avg("raw_score").alias("head"))
    spread = spread.join(head, "doc_id").join(percentiles(values, "raw_score", (0.1, 0.5, 0.9)), "doc_id")
    p10, p50, p90 = (F.col("p")[k] for k in range(3))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return spread.select(
        "doc_id", p10.alias("p10"), p50.alias("p50"), p90.alias("p90"), zero(F.try_divide(p90, p50)).alias("sep_p90_p50"), zero(F.try_divide("head", "mean")).alias("head_over_all"), zero(F.try_divide(p10, p90)).alias("tail_p10_over_p90"), "n_terms",
    )


def adaptive_limits(spread: DataFrame, topn: int) -> DataFrame:
    """How many keywords a chapter gets: fewer if it has few terms or flat scores; core_n of them need evidence."""
    sep = F.col("sep_p90_p50")
    few = F.when(F.col("n_terms") <= 6, F.least(F.lit(topn), F.lit(5))).otherwise(F.lit(topn))
    n = F.when((sep > 0) & (sep < 1.10), F.least(few, F.lit(3))).when((sep > 0) & (sep < 1.25), F.least(few, F.lit(5))).otherwise(few)
    return spread.withColumns({"eff_topn": n, "core_n": F.least(F.lit(4), n)})


def promoted(rows: DataFrame, places: bool = True) -> DataFrame:
    """Single words give way to the best phrase (of the chapter's best 200 terms) that holds them and is no weaker.

    places: adds `place`, the best rank of each term that stays, counting those of the words that gave way to it.
    """
    rows = ranked(rows) if places else rows
    best = ranked(rows.drop("rank"), 200).where(F.contains("term", F.lit(" ")))
    phrases = best.select("doc_id", F.explode(F.array_distinct(F.split("term", " "))).alias("word"), "term", "rank", "page_df", "heading").where("length(word) > 2")
    best = phrases.groupBy("doc_id", "word").agg(F.min_by(F.struct("term", "page_df", "heading"), "rank").alias("phrase"))
    single = F.when(~F.contains("term", F.lit(" ")), F.col("term"))  # null for phrases, which so meet nothing
    joined = rows.withColumn("word", single).join(best, ["doc_id", "word"], "left")
    stronger = F.coalesce((F.col("phrase.page_df") >= F.col("page_df")) | (F.col("phrase.heading") > F.col("heading")) | (F.col("phrase.heading") >= 0.5), F.lit(False))
    if not places:  # phrases give way to nothing
        return joined.where(~stronger).drop("word", "phrase")
    chosen = joined.select("doc_id", F.when(stronger, F.col("phrase.term")).otherwise(F.col("term")).alias("term"), F.col("rank").alias("at"))
    return rows.drop("rank").join(chosen.groupBy("doc_id", "term").agg(F.min("at").alias("place")), ["doc_id", "term"])


# What a term's overlap key leaves out besides white space: marks and particles.
KEY_MARKS, KEY_PARTICLES = "-_,.:;()[]{}", "則的為而與或依所於以"
_LEFT_OUT = str.maketrans("", "", KEY_MARKS + KEY_PARTICLES)


def overlap_key(term: str) -> str:
    """Terms overlap if the key of one holds the other's."""
    return "".join(term.lower().split()).translate(_LEFT_OUT)


def _fit(term: str, page_df: int, heading: float, lang: str) -> bool:
    """Short English words need a heading or several pages."""
    return page_df > 0 and not (lang == "en" and " " not in term and len(term) <= 4 and heading < 0.5 and page_df < 4)


def _filler(term: str, page_df: int, heading: float, lang: str) -> bool:
    """May a term fill a place that is left? Single English words need a title or three pages, and are no verb forms."""
    if not _fit(term, page_df, heading, lang):
        return False
    single = lang == "en" and len(term.split()) == 1
    return not single or not (heading < 1.0 and page_df <= 2 or term.lower().endswith(("ed", "ing")))


class Fold:
    """The greedy choice of a chapter's keywords, as far as its rows (term, raw, tf, page_df, heading) were read in the order of their ranks.

    It reads the rows twice: first for core_n terms that two pages or hits support, then, from the first rank on, for others up
    to eff_topn. A term belongs to the first chosen one that it overlaps, and takes its place if longer, or equally long and better.
    stale: the second round judges by the features of the last row that the first one read.
    """

    def __init__(self, eff_topn: int, core_n: int, lang: str, stale: bool = False, filling: bool = False, at: int = 0, last: tuple = (0, 0.0), places: Iterable[tuple] = ()):
        self.eff_topn, self.core_n, self.lang, self.stale = eff_topn, core_n, lang, stale
        self.filling, self.at, self.last = filling, at, last
        self.places = [(overlap_key(row[0]), tuple(row)) for row in places]
        self.done = False

    def _place(self, row: tuple) -> int | None:
        """The place that a row would get, if it is one for this round and better than what stands there."""
        term, raw, tf, *seen = row
        if self.filling:
            fit = _filler(term, *(self.last if self.stale else seen), self.lang)
        else:
            fit = _fit(term, *seen, self.lang) and max(seen[0], tf) >= 2
        if not fit:
            return None
        key = overlap_key(term)
        at = next((n for n, (old, _) in enumerate(self.places) if key in old or old in key), len(self.places))
        held = self.places[at][1] if at < len(self.places) else ("", 0.0)
        return at if at == len(self.places) or (len(term), raw) > (len(held[0]), held[1]) else None

    def changed_by(self, row: tuple) -> bool:
        return self._place(row) is not None

    def read(self, rows: Iterable[tuple[int, tuple]], n_rows: int) -> None:
        """Reads on; rows: (rank, row) beyond `at`, of which none that is left out would change the choice. n_rows: of the chapter."""
        for rank, row in rows:
            self.at = rank
            if not self.filling:
                self.last = tuple(row[3:5])
            place = self._place(row)
            if place is not None:
                self.places[place : place + 1] = [(overlap_key(row[0]), row)]
                if len(self.places) >= (self.eff_topn if self.filling else self.core_n):
                    return self.over()
        if self.at >= n_rows:
            self.over()

    def over(self) -> None:
        """The round ends: it is full, or no row that is left would change it."""
        if self.filling or len(self.places) >= self.eff_topn:
            self.done = True
        else:
            self.filling, self.at = True, 0

    def rows(self) -> list[tuple]:
        return [row for _, row in self.places]


def choose(rows: Iterable[tuple], eff_topn: int, core_n: int, lang: str, compat_stale_features: bool = False) -> list[tuple]:
    """The greedy choice among all rows of a chapter, given in order."""
    listed, fold = list(enumerate(rows, 1)), Fold(eff_topn, core_n, lang, compat_stale_features)
    while listed and not fold.done:
        fold.read(listed, len(listed))
    return fold.rows()


#: Ranks that a task reads of a chapter at a time; up to 1,000, Spark takes the first ones from each task before its shuffle.
WINDOW_RANKS = 1000
_ROW = ["term", "raw_score", "tf", "page_df", "heading"]
_PLACES = "array<struct<term:string,raw_score:double,tf:long,page_df:long,heading:double>>"
_STATE = f"doc_id string, eff_topn int, core_n int, n_terms long, filling boolean, at long, last_df long, last_heading double, places {_PLACES}, done boolean"
_STATE_COLUMNS = ["doc_id", "eff_topn", "core_n", "n_terms", "filling", "at", "last_df", "last_heading", "places", "done"]


def _resumed(state, lang: str, stale: bool) -> Fold:
    return Fold(int(state.eff_topn), int(state.core_n), lang, stale, bool(state.filling), int(state.at), (int(state.last_df), float(state.last_heading)), [tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in state.places])


def _reader(lang: str, stale: bool):
    """The state of a chapter's choice after it read a window; without rows there is none that would change it."""

    def run(states: pd.DataFrame, window: pd.DataFrame) -> pd.DataFrame:
        out = []
        for state in states.itertuples(index=False):
            fold = _resumed(state, lang, stale)
            listed = list(zip(window["rank"].tolist(), window[_ROW].itertuples(index=False, name=None), strict=True)) if len(window) else []
            listed.sort(key=lambda x: x[0])
            fresh = not fold.at and not fold.filling
            if listed:
                fold.read(listed, state.n_terms)
                if fresh and fold.filling and not fold.done:  # the second round begins with the rows at hand
                    fold.read(listed, state.n_terms)
            else:
                fold.last = (int(state.end_df), float(state.end_heading)) if not fold.filling else fold.last
                fold.over()
            places = [dict(zip(_ROW, row, strict=True)) for row in fold.rows()]
            out.append((state.doc_id, state.eff_topn, state.core_n, state.n_terms, fold.filling, fold.at, int(fold.last[0]), float(fold.last[1]), places, fold.done))
        return pd.DataFrame(out, columns=_STATE_COLUMNS)

    return run


def _changes(lang: str, stale: bool):
    """(doc_id, rank) of the first row of each batch and chapter that would change the choice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first: dict[str, int] = {}
            for doc_id, part in batch.groupby("doc_id", sort=False):
                fold = _resumed(next(part.itertuples(index=False)), lang, stale)
                ranks = [r for r, row in zip(part["rank"].tolist(), part[_ROW].itertuples(index=False, name=None), strict=True) if fold.changed_by(row)]
                if ranks:
                    first[doc_id] = min(ranks)
            yield pd.DataFrame({"doc_id": list(first), "next": list(first.values())}).astype({"doc_id": object, "next": "int64"})

    return run


def selected(rows: DataFrame, limits: DataFrame, lang: str = "en", compat_stale_features: bool = False) -> DataFrame:
    """The keywords of each chapter, by the greedy choice; rows: ranked terms, limits: of adaptive_limits.

    The choice is a fold over windows of WINDOW_RANKS. For chapters that are still open all tasks look for the first row that
    would change the choice, and the next window begins there: a task holds a window, and there are no more rounds than changes.
    """
    return _selected(rows.where(F.col("rank") <= WINDOW_RANKS), lambda chapters: rows.join(chapters, "doc_id", "left_semi"), limits, lang, compat_stale_features)


def _selected(first: DataFrame, whole: Callable[[DataFrame], DataFrame], limits: DataFrame, lang: str, stale: bool) -> DataFrame:
    """first: the rows of the first window; whole: ranked rows of some chapters, which are only asked for where one window does not do."""
    given = ["doc_id", F.col("rank").cast("long").alias("rank"), "term", "raw_score", F.col("tf").cast("long").alias("tf"), F.col("page_df").cast("long").alias("page_df"), F.col("heading").cast("double").alias("heading")]
    begin = limits.select("doc_id", F.col("eff_topn").cast("int"), F.col("core_n").cast("int"), F.col("n_terms").cast("long"), F.lit(False).alias("filling"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("last_df"), F.lit(0.0).alias("last_heading"), F.array().cast(_PLACES).alias("places"), F.lit(0).cast("long").alias("end_df"), F.lit(0.0).alias("end_heading"))
    read = _reader(lang, stale)
    state = kept(begin.groupBy("doc_id").cogroup(first.select(*given).groupBy("doc_id")).applyInPandas(read, _STATE), "choice")
    finished = [state.where("done")]
    left = None
    while not (still := state.where("NOT done")).isEmpty():
        left = kept(whole(still.select("doc_id")).select(*given), "open") if left is None else left
        ahead = left.join(still, "doc_id").where("rank > at")
        # what the end of a chapter looks like matters where its first round reads on to it
        ends = ahead.groupBy("doc_id").agg(F.max_by(F.struct("page_df", "heading"), "rank").alias("end"))
        found = ahead.mapInPandas(_changes(lang, stale), "doc_id string, next long").groupBy("doc_id").agg(F.min("next").alias("next"))
        told = kept(still.join(ends, "doc_id", "left").join(found, "doc_id", "left"), "told")
        window = left.join(told.where("next IS NOT NULL").select("doc_id", "next"), "doc_id").where(F.col("rank").between(F.col("next"), F.col("next") + WINDOW_RANKS - 1)).drop("next")
        states = told.withColumns({"end_df": F.coalesce("end.page_df", "last_df"), "end_heading": F.coalesce("end.heading", "last_heading")}).drop("end", "next", "done")
        state = kept(states.groupBy("doc_id").cogroup(window.groupBy("doc_id")).applyInPandas(read, _STATE), "choice")
        finished.append(state.where("done"))
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    return every.select("doc_id", F.posexplode("places").alias("n", "p")).select("doc_id", (F.col("n") + 1).alias("rank"), *(f"p.{c}" for c in _ROW[:4]))


def keywords(pages: DataFrame, topn: int = 10, lang: str = "en", compat_stale_features: bool = False) -> DataFrame:
    """The whole chain, from pages (doc_id, pos, text, ocr) to selected keywords."""
    return from_scores(scored(pages, counted(pages, lang), lang), topn, lang, compat_stale_features)


def from_scores(rows: DataFrame, topn: int = 10, lang: str = "en", compat_stale_features: bool = False) -> DataFrame:
    """The selected keywords of scored rows, which are written once and read from there."""
    rows = kept(rows, "scored")
    if lang == "en":
        rows = kept(promoted(rows, places=False), "promoted")
    limits = kept(adaptive_limits(metrics(rows, stored=True), topn), "limits")
    return _selected(ranked(rows, WINDOW_RANKS), lambda chapters: ranked(rows.join(chapters, "doc_id", "left_semi")), limits, lang, compat_stale_features)
