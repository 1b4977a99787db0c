"""Counts of terms that are kept up to date chapter by chapter.

Below a path stand three tables, all in folders by batch: the counts of the terms
of chapters, the chapters with their number of pages, and changes of document
frequencies. A call adds or removes some chapters: it reads the pages that it is
given, and of the chapters that they replace the stored counts, never other
pages. What it writes counts once its batch is listed, which is done last, so a
call takes effect whole or not at all. One call at a time may write.

A chapter is as its last listed batch has it; document frequencies are sums of
changes. `compact` writes what counts as one batch, before which nothing is read.

Defined cases: pages without a chapter are left out. A chapter without terms
counts as a chapter. Removing a chapter that is not there changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import keywords

_COUNTS = "doc_id string, term string, tf long, page_df long, heading double, first struct<pos:long,place:int>, rep_pos long, rep_hits long"
_CHAPTERS = "doc_id string, pages_in_doc long, mark string, gone boolean"
_CHANGES = "term string, change long"
_LIST = "number long, whole boolean, listed string"


class TermCounts:
    def __init__(self, spark: SparkSession, path: str, lang: str = "en"):
        self.spark, self.path, self.lang = spark, f"{path.rstrip('/')}/{lang}", lang

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _listed(self, name: str, schema: str) -> DataFrame:
        """Rows of a table with the number of their batch, from the last whole batch on."""
        batches = self._table("list", _LIST)
        last = batches.agg(F.max(F.when(F.col("whole"), F.col("number"))).alias("n")).first().n
        batches = batches.where(F.col("number") >= F.lit(last or 0))  # a row a call
        return self._table(name, f"{schema}, batch string").join(F.broadcast(batches), F.col("batch") == F.col("listed")).drop("whole", "listed")

    def chapters(self) -> DataFrame:
        """(doc_id, pages_in_doc, mark, batch) of what is there."""
        rows = self._listed("chapters", _CHAPTERS)
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct("pages_in_doc", "mark", "gone", "batch"), "number").alias("x"))
        return last.where("NOT x.gone").select("doc_id", "x.pages_in_doc", "x.mark", "x.batch")

    def counts(self) -> DataFrame:
        """The rows of keywords.term_counts of all chapters."""
        return self._listed("counts", _COUNTS).join(self.chapters().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch", "number")

    def document_frequency(self) -> DataFrame:
        """(term, df)"""
        return self._listed("changes", _CHANGES).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")

    def _put(self, batch: str, name: str, rows: DataFrame) -> DataFrame:
        """Writes rows of a batch, which do not count before it is listed, and reads them from there."""
        return written(rows, f"{self.path}/{name}/batch={batch}")

    def _list(self, batch: str, whole: bool = False) -> None:
        number = (self._table("list", _LIST).agg(F.max("number")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, whole, batch)], _LIST).coalesce(1).write.mode("append").parquet(f"{self.path}/list")

    def add(self, pages: DataFrame, mark: Column | None = None) -> None:
        """Counts the chapters of pages (doc_id, pos, text, ocr), all pages of each; those that are there already are replaced. mark: what tells this state of a chapter."""
        pages = pages.where("doc_id IS NOT NULL")
        batch, mark = uuid.uuid4().hex, F.lit(None).cast("string") if mark is None else mark
        counts = self._put(batch, "counts", keywords.counted(pages, self.lang))
        chapters = self._put(batch, "chapters", pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_in_doc"), F.max(mark).alias("mark")).withColumn("gone", F.lit(False)))
        before = self.counts().join(chapters.select("doc_id"), "doc_id", "left_semi")
        self._put(batch, "changes", _changes(counts, before))
        self._list(batch)

    def remove(self, chapters: DataFrame) -> None:
        """Takes the chapters (doc_id) out."""
        batch = uuid.uuid4().hex
        there = self._put(batch, "chapters", self.chapters().join(chapters.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "pages_in_doc", "mark", F.lit(True).alias("gone")))
        before = self.counts().join(there.select("doc_id"), "doc_id", "left_semi")
        none = self._put(batch, "counts", self.spark.createDataFrame([], _COUNTS))
        self._put(batch, "changes", _changes(none, before))
        self._list(batch)

    def compact(self) -> None:
        """Writes what counts as one batch, from which on all is read."""
        batch = uuid.uuid4().hex
        self._put(batch, "counts", self.counts())
        self._put(batch, "chapters", self.chapters().select("doc_id", "pages_in_doc", "mark", F.lit(False).alias("gone")))
        self._put(batch, "changes", self.document_frequency().select("term", F.col("df").alias("change")))
        self._list(batch, whole=True)

    def scored(self) -> DataFrame:
        """As keywords.scored over the pages of all chapters."""
        counts = self.counts().join(self.document_frequency(), "term")
        return keywords.scored_counts(counts, self.chapters().select("doc_id", "pages_in_doc"), self.lang)

    def keywords(self, topn: int = 10) -> DataFrame:
        """As keywords.keywords over the pages of all chapters."""
        return keywords.from_scores(self.scored(), topn, self.lang)


def _changes(after: DataFrame, before: DataFrame) -> DataFrame:
    """(term, change): in how many more chapters a term is after than before."""
    rows = after.select("term", F.lit(1).cast("long").alias("change")).unionByName(before.select("term", F.lit(-1).cast("long").alias("change")))
    return rows.groupBy("term").agg(F.sum("change").alias("change")).where("change <> 0")
