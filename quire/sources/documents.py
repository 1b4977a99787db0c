"""Files to pages: finding, extracting and recognising, with a status per file.

Readers are plugins (providers.Extractor, providers.Recogniser) that run in Arrow
batches next to the bytes; a file that fails is a status, never a failed job.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NO_TEXT, filled, strip
from ..providers import Extractor, Recogniser

#: Files in one Arrow batch: their bytes are held at once.
FILES_AT_ONCE = 16
# Images that are recognised.
RASTER = ["png", "jpg", "jpeg"]
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"\.([^.]+)$", 1))


def files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, doc_id, ext, content) of the files under a folder; doc_id is the name without extension."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = found.select("path", stem(F.col("path")).alias("doc_id"), extension(F.col("path")).alias("ext"), "content")
    return rows.where(F.col("ext").isin(extensions)) if extensions else rows


def document_folders(paths: DataFrame) -> DataFrame:
    """(folder, path) of the text of each document folder that has one: the file named like the folder, else the first by name; folders that start with _ are left out. paths: (path)."""
    parts = paths.select("path", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"))
    texts = parts.where((F.trim("folder") != "") & ~F.startswith("folder", F.lit("_")) & (extension(F.col("path")) == "txt"))
    order = F.struct((stem(F.col("path")) != F.col("folder")).alias("other"), _name(F.col("path")).alias("name"))
    return texts.groupBy("parent", "folder").agg(F.min_by("path", order).alias("path")).select("folder", "path")


def _in_small_batches(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInPandas over a few files at a time, each to any number of rows."""

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for part in parts:
            for at in range(0, len(part), FILES_AT_ONCE):
                out = [r for row in part.iloc[at : at + FILES_AT_ONCE].itertuples(index=False) for r in run(row)]
                yield pd.DataFrame(out, columns=names).astype(object)

    return rows.mapInPandas(apply, schema)


def extracted(found: DataFrame, extractor: Extractor) -> DataFrame:
    """(doc_id, page, text, status) of files (doc_id, content): done, or failed with page null. A page without text has null."""

    def read(row) -> list[tuple]:
        try:
            pages = extractor.pages(bytes(row.content))
        except Exception:  # noqa: BLE001  a broken file is a status
            return [(row.doc_id, None, None, "failed")]
        return [(row.doc_id, int(n), t if t and t.strip() else None, "done") for n, t in pages]

    return _in_small_batches(found.select("doc_id", "content"), read, "doc_id string, page int, text string, status string")


def extracted_images(found: DataFrame, extractor: Extractor) -> DataFrame:
    """(doc_id, page, img, name, content, status) of the pictures in files (doc_id, content), named page_NNN_img_NN."""

    def read(row) -> list[tuple]:
        try:
            pictures = extractor.images(bytes(row.content))
        except Exception:  # noqa: BLE001
            return [(row.doc_id, None, None, None, None, "failed")]
        return [(row.doc_id, int(p), int(i), f"page_{p:03d}_img_{i:02d}.{ext}", data, "done") for p, i, ext, data in pictures]

    return _in_small_batches(found.select("doc_id", "content"), read, "doc_id string, page int, img int, name string, content binary, status string")


def recognised(images: DataFrame, done: DataFrame, engine: Recogniser) -> DataFrame:
    """(doc_id, stem, ocr, status) of images (doc_id, name, content): skipped if no raster image or already in done (doc_id, stem), failed if it cannot be read, else new."""
    known = done.select("doc_id", "stem", F.lit(True).alias("there")).distinct()
    rows = images.select("doc_id", stem(F.col("name")).alias("stem"), extension(F.col("name")).isin(RASTER).alias("raster"), "content").join(known, ["doc_id", "stem"], "left")
    skip = ~F.col("raster") | F.col("there").isNotNull()

    def read(row) -> list[tuple]:
        try:
            return [(row.doc_id, row.stem, engine.text(bytes(row.content)).strip(), "new")]
        except Exception:  # noqa: BLE001
            return [(row.doc_id, row.stem, None, "failed")]

    schema = "doc_id string, stem string, ocr string, status string"
    read_now = _in_small_batches(rows.where(~skip).select("doc_id", "stem", "content"), read, schema)
    return read_now.unionByName(rows.where(skip).select("doc_id", "stem", F.lit(None).cast("string").alias("ocr"), F.lit("skipped").alias("status")))


def status_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many rows of each key are new, skipped and failed."""
    return rows.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "skipped", "failed")))


def page_file(pages: DataFrame) -> DataFrame:
    """(doc_id, content): the pages (doc_id, page, text) of a document as one text with page headers, which pages.page_blocks reads."""
    block = F.concat(F.lit("====== Page "), F.col("page").cast("string"), F.lit(" ======\n"), filled(F.col("text"), F.lit(NO_TEXT)))
    blocks = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", block.alias("block")))).alias("x"))
    return blocks.select("doc_id", F.array_join(F.transform("x", lambda b: b["block"]), "\n\n").alias("content"))


def decoded(content: Column) -> Column:
    """The text of bytes, without what is no UTF-8; null is empty."""
    valid = F.make_valid_utf8(F.coalesce(content, F.lit(b"")).cast("string"))
    return strip(F.replace(valid, F.lit("�"), F.lit("")))


class SlideReader:
    """Texts and pictures of .pptx bytes, which are a zip of XML: slides in the order of the presentation, shapes in theirs."""

    def _slides(self, archive: zipfile.ZipFile) -> list[str]:
        links = self._links(archive, "ppt/presentation.xml")
        shown = ET.fromstring(archive.read("ppt/presentation.xml")).iter()
        return [links[e.attrib[f"{_RELATION}id"]] for e in shown if e.tag.endswith("}sldId")]

    def _links(self, archive: zipfile.ZipFile, part: str) -> dict[str, str]:
        folder, name = posixpath.split(part)
        listed = f"{folder}/_rels/{name}.rels"
        if listed not in archive.namelist():
            return {}
        found = ET.fromstring(archive.read(listed))
        return {r.attrib["Id"]: posixpath.normpath(posixpath.join("/" if r.attrib["Target"].startswith("/") else folder, r.attrib["Target"])).lstrip("/") for r in found}

    @staticmethod
    def _text(shape: ET.Element) -> str:
        lines = []
        for p in (e for e in shape.iter() if e.tag.endswith("}p")):
            lines.append("".join((e.text or "") if e.tag.endswith("}t") else "\v" if e.tag.endswith("}br") else "" for e in p.iter()))
        return "\n".join(lines)

    def pages(self, content: bytes) -> list[tuple[int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            out = []
            for n, slide in enumerate(self._slides(archive), 1):
                shapes = [e for e in ET.fromstring(archive.read(slide)).iter() if e.tag.endswith("}sp")]
                out.append((n, "\n".join(t for t in map(self._text, shapes) if t)))
            return out

    def images(self, content: bytes) -> list[tuple[int, int, str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            out = []
            for n, slide in enumerate(self._slides(archive), 1):
                links = self._links(archive, slide)
                shown = [e.attrib[f"{_RELATION}embed"] for pic in ET.fromstring(archive.read(slide)).iter() if pic.tag.endswith("}pic") for e in pic.iter() if e.tag.endswith("}blip") and f"{_RELATION}embed" in e.attrib]
                out += [(n, k, (posixpath.splitext(links[i])[1][1:] or "png").lower(), archive.read(links[i])) for k, i in enumerate(shown, 1)]
            return out


class TextReader:
    """Pages of plain text, parted by form feeds; it has no pictures."""

    def pages(self, content: bytes) -> list[tuple[int, str]]:
        return list(enumerate(re.split("\f", content.decode("utf-8", "ignore")), 1))

    def images(self, content: bytes) -> list[tuple[int, int, str, bytes]]:
        return []
