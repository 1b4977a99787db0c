"""Reading and writing pages, indexes and assets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NO_TEXT, filled, fixed, index_text, strip
from .scratch import kept

PAGE = "doc_id STRING, page INT, text STRING, images ARRAY<STRING>, ocr STRING"
#: Rows as they come: any of several names for a column, and images in any shape, as JSON text.
LOOSE = "doc_id STRING, doc STRING, ch STRING, source_doc STRING, page STRING, page_no STRING, pageno STRING, page_num STRING, text STRING, ocr STRING, ocrs STRING, image STRING, images STRING"
ASSET_NAME = r"(?i)page_(\d+)_img_(\d+)\.(png|jpg|jpeg)$"
PAGE_HEADER = r"(?i)^=+\s*Page\s+(\d+)\s*=+$"
# The keys of an object that may hold an image path, in order.
IMAGE_KEYS = ["rel_path", "path", "file_name", "name", "image", "url", "image_url"]


def read_jsonl(spark: SparkSession, path: str, schema: str = PAGE, required: bool = False) -> DataFrame:
    """JSON lines; a bad line fails the read, blank lines are skipped. required: an empty input fails."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if required and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the lines that are neither blank nor JSON, lines numbered from 1.

    Files are read in byte ranges. Which lines are bad is written with the place of each line in its range; the lines
    of the ranges before it, a sum over one row a range, make it the number in the file.
    """
    bad = (strip(F.col("value")) != "") & F.try_parse_json("value").isNull()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.when(bad, F.col("value")).alias("text"))
    lines = kept(lines, "lines")
    ranges = lines.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.where("text IS NOT NULL").join(ranges, ["path", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def checked_jsonl(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """read_jsonl of an input that has rows; fails with the place of the first line that is no JSON."""
    bad = bad_lines(spark, path).orderBy("file", "line").first()
    if bad:
        raise ValueError(f"{bad.file}, line {bad.line} is no JSON: {bad.text[:80]}")
    return read_jsonl(spark, path, schema, required=True)


def write_jsonl(pages: DataFrame, path: str, by_doc: bool = True) -> None:
    """JSON lines, one folder per chapter; null texts get the no-text mark."""
    rows = pages.withColumn("text", filled(F.col("text"), F.lit(NO_TEXT)))
    if by_doc:
        rows = rows.withColumn("chapter", F.col("doc_id"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("chapter") if by_doc else writer).json(path)


def write_index(index: DataFrame, path: str, subject: str, model: str) -> None:
    """One table (pos, doc_id, page, images, ocr, text, embedding), with its metadata beside it."""
    index.write.mode("overwrite").parquet(f"{path}/rows")
    saved = index.sparkSession.read.parquet(f"{path}/rows")
    sizes = saved.agg(F.count(F.lit(1)).cast("int").alias("count"), F.max(F.size("embedding")).alias("dim"))
    sizes.select(F.lit(subject).alias("subject"), "count", "dim", F.lit(model).alias("model"), F.lit(path).alias("output_dir")).write.mode("overwrite").json(f"{path}/info")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index table; its size, dimension and model are checked against the metadata."""
    rows, info = spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/info").first()
    if not info or not info["model"]:
        raise ValueError("index information has no model")
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if found.n != info["count"] or found.n and (found.lo, found.hi) != (info["dim"], info["dim"]):
        raise ValueError("index rows do not match their information")
    return rows


def page_number(c: Column) -> Column:
    return F.when(strip(c).rlike("^[0-9]{1,9}$"), strip(c).try_cast("int"))


def image_paths(*values: str | None) -> list[str]:
    """The paths in plain or JSON texts, distinct, in order: objects give the values of IMAGE_KEYS, then their images."""
    keys = [*IMAGE_KEYS, "images"]

    def decoded(text: str):
        try:
            return json.loads(text, object_pairs_hook=lambda pairs: [dict(pairs)[k] for k in keys if k in dict(pairs)])
        except ValueError:
            return text

    left, found = [decoded(v) for v in reversed(values) if v is not None], {}
    while left:
        value = left.pop()
        if isinstance(value, list):
            left += reversed(value)
        elif isinstance(value, str) and value.strip():
            found.setdefault(value.strip())
    return list(found)


def images_of(image: str, images: str) -> Column:
    """Columns image and images, as JSON or plain text, to a list of paths."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def paths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([image_paths(x, y) for x, y in zip(a, b, strict=True)])

    return paths(image, images)


def first_image(image: Column, images: Column) -> Column:
    """The image of a page, else the first of its images, if it is not blank."""
    return F.coalesce(F.when(strip(image) != "", strip(image)), F.when(strip(F.get(images, 0)) != "", strip(F.get(images, 0))))


def canonical(rows: DataFrame) -> DataFrame:
    """LOOSE rows to pages: the first filled name of each column."""
    return rows.select(
        F.coalesce(strip(filled(F.col("doc_id"), F.col("doc"), F.col("ch"), F.col("source_doc"))), F.lit("unknown")).alias("doc_id"),
        page_number(F.coalesce("page", "page_no", "pageno", "page_num")).alias("page"),
        F.when(strip(F.col("text")) != NO_TEXT, F.col("text")).alias("text"),
        images_of("image", "images").alias("images"),
        filled(F.col("ocr"), F.col("ocrs")).alias("ocr"),
    )


def page_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, page, text) of texts (doc_id, content) with page headers: lines before the first header are dropped, and the last block of a repeated page counts."""
    lines = files.select("doc_id", F.posexplode(F.split("content", r"\R")).alias("n", "line")).withColumn("number", F.when(strip(F.col("line")).rlike(PAGE_HEADER), F.regexp_extract(strip(F.col("line")), PAGE_HEADER, 1).try_cast("int")))
    by = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.last(F.when(F.col("number").isNotNull(), F.struct(F.col("n").alias("at"), "number")), True).over(by)).where("head IS NOT NULL")
    blocks = lines.groupBy("doc_id", F.col("head.number").alias("page"), F.col("head.at").alias("at")).agg(F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("n", "line")))).alias("x"))
    texts = blocks.select("doc_id", "page", "at", strip(F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("text"))
    return texts.groupBy("doc_id", "page").agg(F.max_by("text", "at").alias("text"))


def assets(paths: DataFrame) -> DataFrame:
    """(doc_id, page, img, path) of image files (doc_id, path) named after their page; other names are left out."""
    name = F.col("path")
    return paths.where(name.rlike(ASSET_NAME)).select("doc_id", F.regexp_extract(name, ASSET_NAME, 1).try_cast("int").alias("page"), F.regexp_extract(name, ASSET_NAME, 2).try_cast("int").alias("img"), "path")


def with_ocr(images: DataFrame, ocr: DataFrame) -> DataFrame:
    """Images with the text of the OCR file of their name, empty if there is none. ocr: (doc_id, stem, ocr)."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    return images.withColumn("stem", stem).join(ocr, ["doc_id", "stem"], "left").drop("stem").withColumn("ocr", F.coalesce("ocr", F.lit("")))


def assembled(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Pages of text (doc_id, page, text) and of images (doc_id, page, img, path, ocr), on either side or both."""
    side = images.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("img", "path", "ocr"))).alias("x"))
    side = side.select("doc_id", "page", F.transform("x", lambda v: v["path"]).alias("images"), F.array_join(F.filter(F.transform("x", lambda v: strip(v["ocr"])), lambda o: o != ""), "\n\n").alias("ocr"))
    joined = texts.join(side, ["doc_id", "page"], "full_outer")
    return joined.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("images", F.array().cast("array<string>")).alias("images"), F.coalesce("ocr", F.lit("")).alias("ocr"))


def crop_rule(boxes: DataFrame, least: int = 80, most_area: float = 0.9) -> DataFrame:
    """Which pictures of a page (doc, page, img, w, h, page_w, page_h) are cropped: not those under `least` pixels or over most_area of the page; a page left with none is taken whole (img null)."""
    good = (F.col("w") >= least) & (F.col("h") >= least) & (F.col("w") * F.col("h") / (F.col("page_w") * F.col("page_h")) <= most_area)
    kept = boxes.where(good).select("doc", "page", "img")
    whole = boxes.select("doc", "page").distinct().join(kept, ["doc", "page"], "left_anti").select("doc", "page", F.lit(None).cast("int").alias("img"))
    return kept.unionByName(whole)


# The marks of a printed result list.
LOG_START, LOG_DOC, LOG_IMAGES = r"(?i)^#(\d+)\s+score\s*=\s*([0-9.]+)", r"(?i)^doc_id\s*=\s*(.*?)\s+page\s*=\s*(.+?)\s*$", r"(?i)^images\s*=\s*(.+)$"
LOG_PART, LOG_END = r"(?i)^(ocr|text)\s*:$", r"^-{20,}$"
LOG_PATH = r"""['"]([^'"]+\.(?:png|jpg|jpeg|gif|webp|bmp|svg|PNG|JPG|JPEG|GIF|WEBP|BMP|SVG))['"]"""


def result_log(logs: DataFrame) -> DataFrame:
    """Records (log_id, record, rank, score, doc_id, page, images, ocr, text) of printed result lists (log_id, log), each closed by a rule of dashes.

    Lines are numbered; a running count of starts gives the record of a line, and the last mark before it its part.
    """
    lines = logs.select("log_id", F.posexplode(F.split("log", r"\R")).alias("n", "line")).withColumn("s", strip(F.col("line")))
    s = F.col("s")
    kind = F.when(s.rlike(LOG_START), "start").when(s.rlike(LOG_DOC), "doc").when(s.rlike(LOG_IMAGES), "images").when(s.rlike(LOG_PART), F.lower(F.regexp_extract(s, LOG_PART, 1))).when(s.rlike(LOG_END), "end").otherwise("line")
    so_far = Window.partitionBy("log_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("kind", kind).withColumns({"record": F.count_if(F.col("kind") == "start").over(so_far), "part": F.last(F.when(F.col("kind").isin("start", "ocr", "text", "end"), F.col("kind")), True).over(so_far)})
    lines = lines.where("record > 0 AND (part <> 'end' OR kind = 'end')")
    last = lambda k, value: F.max_by(F.when(F.col("kind") == k, value), F.when(F.col("kind") == k, F.col("n")))
    body = lambda part: F.array_sort(F.collect_list(F.when((F.col("kind") == "line") & (F.col("part") == part), F.struct("n", "line"))))
    rows = lines.groupBy("log_id", "record").agg(
        last("start", F.regexp_extract(s, LOG_START, 1).try_cast("int")).alias("rank"), last("start", F.regexp_extract(s, LOG_START, 2).try_cast("double")).alias("score"),
        last("doc", F.regexp_extract(s, LOG_DOC, 1)).alias("doc_id"), last("doc", F.regexp_extract(s, LOG_DOC, 2)).alias("page"),
        last("images", F.regexp_extract_all(s, F.lit(LOG_PATH), F.lit(1))).alias("images"), body("ocr").alias("ocr"), body("text").alias("text"),
    )
    told = lambda part: strip(F.array_join(F.transform(part, lambda x: x["line"]), "\n")).alias(part)
    none = F.array().cast("array<string>")
    return rows.select("log_id", "record", "rank", "score", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "page", F.transform(F.coalesce("images", none), strip).alias("images"), told("ocr"), told("text"))


def printed(hits: DataFrame) -> DataFrame:
    """Adds `printed`, a hit (rank, score, doc_id, page, images, ocr, text) as the lines that result_log reads."""
    images = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    seen = F.when(strip(F.coalesce("ocr", F.lit(""))) != "", F.concat(F.lit("  OCR:\n"), F.col("ocr"), F.lit("\n"))).otherwise("")
    head = F.format_string("#%d score = %s\ndoc_id = %s page = %s\n  images = ", F.col("rank").cast("int"), fixed(F.col("score"), 4), F.col("doc_id"), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    return hits.withColumn("printed", F.concat(head, images, F.lit("\n"), seen, F.lit("  TEXT:\n"), F.coalesce("text", F.lit("")), F.lit("\n" + "-" * 60)))


def index_rows(pages: DataFrame) -> DataFrame:
    """What is indexed: (pos, doc_id, page, images, ocr, text) of the pages that have any text, text being that of index_text."""
    return pages.select("pos", "doc_id", "page", "images", "ocr", index_text(F.col("text"), F.col("ocr")).alias("text")).where("text <> ''")
