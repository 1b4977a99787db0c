"""Page browsing and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NO_TEXT, strip


def page_keys(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, label, has_text, has_ocr, image_count)."""
    text, ocr = (strip(F.coalesce(c, F.lit(""))) for c in ("text", "ocr"))
    images = F.size(F.coalesce("images", F.array().cast("array<string>"))) if "images" in pages.columns else F.lit(0)
    label = F.concat(F.col("doc_id"), F.lit(" / p"), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    return pages.select("doc_id", "page", "pos", label.alias("label"), (~text.isin("", NO_TEXT)).alias("has_text"), (ocr != "").alias("has_ocr"), images.alias("image_count"))


def page_lookup(pages: DataFrame, doc_id: str | None = None, page: int | None = None) -> DataFrame:
    """The first page of the chapter and number asked for, if any."""
    rows = pages if doc_id is None else pages.where(F.col("doc_id") == doc_id)
    rows = rows if page is None else rows.where(F.col("page") == page)
    return rows.orderBy("pos").limit(1)


#: Places of pages that one window holds.
SPAN = 100_000


def neighbours(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, page, previous, next) in page order of each chapter.

    A chapter is cut into spans of places, so that no task holds a whole one; the pages at the borders of a span come from the spans beside it.
    """
    part = F.floor(F.col("pos") / F.lit(span))
    by, across = Window.partitionBy("doc_id", "part").orderBy("pos"), Window.partitionBy("doc_id").orderBy("part")
    rows = pages.select("doc_id", "page", "pos", part.alias("part"))
    ends = rows.groupBy("doc_id", "part").agg(F.min_by("page", "pos").alias("first"), F.max_by("page", "pos").alias("last"))
    ends = ends.select("doc_id", "part", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after"))
    inner = rows.select("doc_id", "part", "page", *(f(F.struct("page")).over(by).alias(n) for f, n in ((F.lag, "p"), (F.lead, "n"))))
    pick = lambda near, border: F.when(F.col(near).isNull(), F.col(border)).otherwise(F.col(f"{near}.page"))
    return inner.join(ends, ["doc_id", "part"]).select("doc_id", "page", pick("p", "before").alias("previous"), pick("n", "after").alias("next"))


def rollup(files: DataFrame, by: list[str], names: str) -> DataFrame:
    """The sorted distinct names and the number of rows of each group."""
    pairs = files.groupBy(*by, names).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*by).agg(F.sort_array(F.collect_list(names)).alias(f"{names}s"), F.sum("n").alias("file_count"))


def first_source(files: DataFrame, by: list[str], priority: str) -> DataFrame:
    """The rows of each group that have its least priority."""
    return files.join(files.groupBy(*by).agg(F.min(priority).alias(priority)), [*by, priority])


def latest(files: DataFrame, by: list[str]) -> DataFrame:
    """The path of the newest file of each group."""
    return files.groupBy(*by).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def resolved_images(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(image, path): the file of that path, else one of that name, best from a raw_img folder."""
    clean = F.regexp_replace(F.regexp_replace(F.replace("image", F.lit("\\"), F.lit("/")), r"^[./]+", ""), "^data/", "")
    asked = asked.select("image", clean.alias("clean"), F.regexp_extract(clean, r"([^/]*)$", 1).alias("name"))
    files = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    found = asked.join(files, "name").where("name <> ''").withColumn("order", F.when(F.col("path") == F.col("clean"), 0).when(F.contains("path", F.lit("raw_img")), 1).otherwise(2))
    return found.groupBy("image").agg(F.min_by("path", F.struct("order", "path")).alias("path"))
