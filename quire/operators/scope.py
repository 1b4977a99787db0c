"""Chapters: order, selection and merging."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import MERGED, natural_key
from .numbering import numbered


def chapters(pages: DataFrame) -> DataFrame:
    """(ordinal, doc_id) in natural order; names of merged scopes are left out. One row per chapter."""
    names = pages.select("doc_id").distinct().where(~F.col("doc_id").rlike(MERGED) & (F.trim("doc_id") != ""))
    return names.select(F.row_number().over(Window.orderBy(natural_key(F.col("doc_id")), "doc_id")).alias("ordinal"), "doc_id")


def by_range(listed: DataFrame, span: str) -> DataFrame:
    """Ordinals a to b of "a-b" or "a", in either order; the end is cut to the list, a start beyond it fails."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", span)
    if not m:
        raise ValueError(f"not a range: {span}")
    a, b = sorted((int(m[1]), int(m[2] or m[1])))
    if a > listed.count() or a < 1:
        raise ValueError("the range starts outside the list")
    return listed.where(F.col("ordinal").between(a, b)).withColumn("selected", F.col("ordinal") - a + 1)


def by_pick(listed: DataFrame, pick: str) -> DataFrame:
    """The ordinals of "1, 3, 5" in their order, once each."""
    parts = [p.strip() for p in pick.split(",") if p.strip()]
    if any(not p.isdigit() for p in parts):
        raise ValueError(f"not a pick: {pick}")
    ids = list(dict.fromkeys(int(p) for p in parts))
    n = listed.count()
    if any(not 1 <= i <= n for i in ids):
        raise ValueError("the pick is outside the list")
    at = F.array_position(F.array(*(F.lit(i) for i in ids)), F.col("ordinal")).cast("int")
    return listed.where(F.col("ordinal").isin(ids)).withColumn("selected", at)


def by_names(listed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """From one chapter to another by name, in either order."""
    found = {r.doc_id: r.ordinal for r in listed.where(F.col("doc_id").isin([x for x in (start, end) if x])).collect()}  # two at most
    for name in (start, end):
        if name and name not in found:
            raise ValueError(f"no chapter {name}")
    n = listed.count()
    a, b = sorted((found[start] if start else 1, found[end] if end else n))
    return listed.where(F.col("ordinal").between(a, b)).withColumn("selected", F.col("ordinal") - a + 1)


def choose(listed: DataFrame, pick: str | None = None, span: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A pick counts before a range, a range before names."""
    return by_pick(listed, pick) if pick else by_range(listed, span) if span else by_names(listed, start, end)


def placed(merged_pages: DataFrame) -> DataFrame:
    """Pages of a merge (selected, pos) with a position `pos` of their own from 0, in the order of the selection."""
    rows = numbered(merged_pages, [F.col("selected"), F.col("pos"), F.col("page"), F.col("doc_id")], "_pos")
    return rows.drop("pos").withColumnRenamed("_pos", "pos")


def merged(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The pages of the selected chapters, with their order (selected, pos)."""
    return pages.join(F.broadcast(selection.select("doc_id", "selected")), "doc_id")  # a selection is stated by hand
