"""Chapter names: numerals, order and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Shapes of chapter names.
EN_CHAPTER = r"(?i)\b(?:CH|Chapter|Chap|Lesson|Lecture|Unit)\s*[-_ ]?\s*(\d{1,3})\b"
CN_CHAPTER = r"第\s*([一二三四五六七八九十零\d]+)\s*(章|節|講|回|單元|章節)"
ROMAN_CHAPTER = r"(?i)^\(\s*([IVXLCDM]+)\s*\)"
TRAILING_NUMBER = r"(?:^|[^0-9])[-_ ](\d{1,3})(?:\s*\(|\s*\[|\.|_|-|$)"
CH_NAME = r"^CH(\d{2})(?:[_\-\s\(].*)?$"
MERGED = r"\)\s*-\s*\("
# Numerals.
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def _digits(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def roman_to_int(c: Column) -> Column:
    """A digit before a larger one is taken off. Null for other characters."""
    s = F.upper(strip(c))
    digits = F.transform(F.reverse(F.split(s, "")), lambda x: F.element_at(_digits(ROMAN_DIGITS), x))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("top"))
    add = lambda a, x: F.struct((a["total"] + F.when(x < a["top"], -x).otherwise(x)).alias("total"), F.greatest(a["top"], x).alias("top"))
    return F.when(s.rlike("^[IVXLCDM]+$"), F.aggregate(digits, start, add, lambda a: a["total"]))


def cn_to_int(c: Column) -> Column:
    """Chinese numerals up to 99, or plain digits. Null for other characters."""
    s = strip(c)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"))

    def add(a, x):
        ten = x == "十"
        return F.struct(
            F.when(ten, a["total"] + F.when(a["num"] > 0, a["num"]).otherwise(1) * 10).otherwise(a["total"]).alias("total"),
            F.when(ten, F.lit(0)).otherwise(F.coalesce(F.element_at(_digits(CN_DIGITS), x), F.lit(0))).alias("num"),
        )

    value = F.aggregate(F.split(s, ""), start, add, lambda a: a["total"] + a["num"])
    return F.coalesce(F.when(s.rlike(r"^\d{1,9}$"), s.try_cast("int")), F.when(s.rlike("^[零一二兩三四五六七八九十]+$"), value))


def _found(c: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def order_hint(stem: Column) -> Column:
    """(priority, number) of a name with a chapter number, else null."""
    hints = [_found(stem, EN_CHAPTER).try_cast("int"), cn_to_int(_found(stem, CN_CHAPTER)), roman_to_int(_found(stem, ROMAN_CHAPTER)), _found(stem, TRAILING_NUMBER).try_cast("int")]
    return F.coalesce(*(F.when(n.isNotNull(), F.struct(F.lit(k).alias("priority"), n.alias("number"))) for k, n in enumerate(hints)))


def natural_key(stem: Column) -> Column:
    """Sorts names with a chapter number first, by it; others by their runs of digits and text. Digits sort before text."""
    hint = order_hint(stem)
    runs = F.regexp_extract_all(stem, F.lit(r"(\d+|\D+)"), F.lit(1))
    runs = F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 20, "0"))).otherwise(F.concat(F.lit("1"), F.lower(x))))
    return F.struct(
        F.when(hint.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(hint["priority"], F.lit(0)).alias("priority"), F.coalesce(hint["number"], F.lit(0)).alias("number"),
        F.when(hint.isNull(), runs).otherwise(F.array(F.lower(stem))).alias("runs"),
    )


def chapter_tag(stem: Column) -> Column:
    """The label of a chapter name, or null."""
    s = strip(stem)
    roman, cn, ch, en = _found(s, ROMAN_CHAPTER), _found(s, CN_CHAPTER), _found(F.upper(s), CH_NAME), _found(s, EN_CHAPTER)
    return F.coalesce(F.upper(roman), F.when(cn_to_int(cn).isNotNull(), F.concat(F.lit("第"), cn, F.lit("章"))), F.concat(F.lit("CH"), ch), F.concat(F.lit("Chapter "), en.try_cast("int").cast("string")))


def chapter_label(stem: Column) -> Column:
    """The bare number or numeral of a chapter name, or null."""
    upper = F.upper(strip(stem))
    return F.coalesce(F.upper(_found(stem, ROMAN_CHAPTER)), _found(stem, EN_CHAPTER).try_cast("int").cast("string"), cn_to_int(_found(stem, CN_CHAPTER)).cast("string"), _found(upper, CH_NAME))


def scope_name(stems: Column, pick: Column | None = None, span: Column | None = None) -> Column:
    """The name of a merged selection: all tags for a pick, first and last for a span, else the numbers asked for."""
    tags = F.transform(stems, lambda s: F.replace(F.coalesce(chapter_tag(s), F.lit("")), F.lit(" "), F.lit("_")))
    first, last = F.element_at(tags, 1), F.element_at(tags, -1)
    span_name = F.when(span.isNotNull(), F.concat(F.lit("range_"), F.replace(F.regexp_replace(span, r"\s+", ""), F.lit("-"), F.lit("_")), F.lit(".jsonl"))) if span is not None else F.lit(None).cast("string")
    run = F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last, F.lit(".jsonl")))
    out = F.coalesce(run, span_name, F.lit("merged.jsonl"))
    if pick is None:
        return out
    numbers = F.concat(F.lit("pick_"), F.replace(F.regexp_replace(pick, r"\s+", ""), F.lit(","), F.lit("_")), F.lit(".jsonl"))
    picked = F.when(F.forall(tags, lambda t: t != ""), F.concat(F.array_join(tags, "_"), F.lit(".jsonl"))).otherwise(numbers)
    return F.when(pick.isNotNull(), picked).otherwise(out)
