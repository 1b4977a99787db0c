"""Results as JSON and Markdown files, in folders that Hadoop file systems reach."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed, squeeze, strip


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in UTF-8."""
    system, where = _file(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, null if it is not there."""
    system, where = _file(spark, path)
    return spark.read.text(path, wholetext=True).first().value if system.exists(where) else None


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def stamp(c: Column) -> Column:
    """A time as part of a file name."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def stamp_now() -> str:
    return time.strftime("%Y%m%d_%H%M%S")


def keyword_items(rows: DataFrame) -> DataFrame:
    """(doc_id, rank, item): keywords as nested records; rows: ranked keywords with their features."""
    representative = F.struct(F.col("rep_pos").alias("page_idx"), F.col("rep_page").alias("page"), F.col("rep_image").alias("image"), F.col("rep_hits").alias("hits"))
    features = F.struct("idf", (F.col("tf") / (F.col("tf") + 3.0)).alias("tf_sat"), "page_df", "pages_in_doc", "coverage", "heading", F.size(F.split("term", " ")).alias("word_count"), F.contains("term", F.lit(" ")).alias("is_phrase"))
    return rows.select("doc_id", "rank", F.struct("term", "raw_score", "score_norm", F.col("raw_score").alias("score"), "tf", "df", representative.alias("representative"), features.alias("features")).alias("item"))


def keyword_json(items: DataFrame) -> DataFrame:
    """(doc_id, json): the keywords of a chapter, a list in order of rank."""
    listed = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.to_json("item").alias("item")))).alias("x"))
    return listed.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda i: i["item"]), ", "), F.lit("]")).alias("json"))


def keyword_markdown(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """(doc_id, n, line): the keywords of every chapter under a heading with its metrics."""
    head = F.format_string("## %s  (sep=%s, head=%s, tail=%s)", "doc_id", *(fixed(F.col(c), 2) for c in ("sep_p90_p50", "head_over_all", "tail_p10_over_p90")))
    return metrics.select("doc_id", F.lit(0).alias("n"), head.alias("line")).unionByName(rows.select("doc_id", F.col("rank").cast("int").alias("n"), keyword_line().alias("line")))


def keyword_line() -> Column:
    shown = strip(squeeze(F.col("term")))
    return F.format_string("%d. %s  (norm=%s, raw=%s, tf=%d, df=%d, page_df=%d)  -> rep_page=%d, hits=%d", "rank", shown, fixed(F.col("score_norm"), 1), fixed(F.col("raw_score"), 4), "tf", "df", "page_df", "rep_page", "rep_hits")


def delete_json(spark: SparkSession, folder: str, name: str) -> str:
    """Removes a .json file of a folder by its bare name; what it removed."""
    bare = name.strip().replace("\\", "/").rsplit("/", 1)[-1]
    if not bare.lower().endswith(".json"):
        raise ValueError("only .json files are removed")
    system, where = _file(spark, f"{folder}/{bare}")
    if not system.exists(where):
        raise FileNotFoundError(f"no {bare} in {folder}")
    system.delete(where, False)
    return f"{folder}/{bare}"
