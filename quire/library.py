"""A library of course pages in one folder: files in, pages, scopes, indexes, searches, keywords and exams out.

Every method is a thin chain of operators over Parquet tables below the root,
which are partitioned by subject and data type, so that work on one corpus reads
its folders alone. Requests are checked here; ValueError is a bad request,
FileNotFoundError something that is not there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import scope_name
from .functions.text import sanitized, static_url
from .operators import answers, browse, counts, exam, keywords, listing, scope, search, stored
from .operators.journal import Journal
from .providers import Embedder, Extractor, HashingEmbedder, LanguageModel, Recogniser, SilentModel, embedded
from .sources import artifacts, documents
from .sources import pages as sources
from .sources.scratch import kept
from .streaming import ingest

# The kinds of files, with their extensions.
DATA_TYPES = {"ppt": ["ppt", "pptx"], "pdf": ["pdf"]}
LANGUAGES = ("cn", "en")


def checked(data_type: str | None = None, lang: str | None = None, **required: str) -> None:
    """Fails for a required text that is blank and for unknown kinds and languages."""
    for name, value in required.items():
        if not (value or "").strip():
            raise ValueError(f"{name} is required")
    if data_type is not None and data_type not in DATA_TYPES:
        raise ValueError(f"data_type has to be one of {', '.join(DATA_TYPES)}")
    if lang is not None and lang not in LANGUAGES:
        raise ValueError(f"lang has to be one of {', '.join(LANGUAGES)}")


class Library:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, model: LanguageModel | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.model = embedder or HashingEmbedder(), model or SilentModel()

    # Tables

    def _path(self, table: str, *parts: str) -> str:
        return "/".join([self.root, table, *parts])

    def _table(self, table: str, schema: str, subject: str | None = None, data_type: str | None = None) -> DataFrame:
        """A table, empty if it was never written."""
        full = f"{schema}, subject string, data_type string"
        try:
            rows = self.spark.read.schema(full).parquet(self._path(table))
        except AnalysisException:
            rows = self.spark.createDataFrame([], full)
        rows = rows if subject is None else rows.where(F.col("subject") == subject)
        return rows if data_type is None else rows.where(F.col("data_type") == data_type)

    def _add(self, table: str, rows: DataFrame, subject: str, data_type: str) -> None:
        rows.withColumns({"subject": F.lit(subject), "data_type": F.lit(data_type)}).write.mode("append").partitionBy("subject", "data_type").parquet(self._path(table))

    RAW = "name string, content binary, added timestamp"
    PAGES = "batch string, doc_id string, page int, text string, images array<string>, ocr string, pos long"
    PICTURES = "batch string, doc_id string, page int, img int, name string, content binary, status string"
    BATCHES = "batch string, doc_id string, digest string, made timestamp"
    SCOPES = "scope string, made timestamp, selected int, doc_id string, page int, text string, images array<string>, ocr string, pos long"
    TIPS = "scope string, lang string, doc_id string, rank int, term string, raw_score double, score_norm double, tf long, df long, page_df long, rep_pos long, rep_hits long, made timestamp"
    ALLOWED = "scope string, lang string, doc_id string, terms array<string>"

    # Files

    def upload(self, subject: str, data_type: str, folder: str) -> DataFrame:
        """Takes the files of a folder in; (name, status). Fails if none can be taken."""
        checked(data_type, subject=subject)
        subject = self.spark.range(1).select(sanitized(F.lit(subject)).alias("s")).first().s
        checked(subject=subject)
        found = documents.files(self.spark, folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
        status = kept(ingest.upload_status(found.select("name"), self.uploads(subject, data_type), DATA_TYPES[data_type]), "uploads")
        taken = status.where("status <> 'skipped'").select("name")
        if taken.isEmpty():
            raise ValueError("no file of this kind")
        self._add("raw", found.join(taken, "name", "left_semi").withColumn("added", F.current_timestamp()), subject, data_type)
        return status

    def uploads(self, subject: str | None = None, data_type: str | None = None) -> DataFrame:
        """(subject, data_type, name, added) of the files, each as it was last taken in."""
        rows = self._table("raw", self.RAW, subject, data_type)
        return rows.groupBy("subject", "data_type", "name").agg(F.max("added").alias("added"))

    def preprocess(self, subject: str, data_type: str, extractor: Extractor, recogniser: Recogniser | None = None) -> DataFrame:
        """Makes pages of the files that have none of their present content; (doc_id, status) of what was read.

        A file is read once for its texts and once for its pictures. The rows of a call are one batch, which counts once its files
        are listed with their digests; that is written last, so pictures and pages appear together or, if a write fails, not at
        all. Of each file the last listed batch counts: a changed file replaces its pages, one that cannot be read keeps them.
        """
        checked(data_type, subject=subject)
        raw = self._table("raw", self.RAW, subject, data_type).groupBy("name").agg(F.max_by("content", "added").alias("content"))
        files = raw.select(documents.stem(F.col("name")).alias("doc_id"), "content", F.sha2("content", 256).alias("digest"))
        files = ingest.pending(files, self._current(subject, data_type), ["doc_id", "digest"])
        batch = F.lit(uuid.uuid4().hex)
        files = kept(files, "files")
        given = files.select("doc_id", "content")
        texts = kept(documents.extracted(given, extractor), "texts")
        pictures = kept(documents.extracted_images(given, extractor).where("status = 'done'"), "pictures")
        shots = pictures.select("doc_id", "page", "img", F.col("name").alias("path"))
        none = self.spark.createDataFrame([], "doc_id string, stem string, ocr string")
        seen = documents.recognised(pictures.select("doc_id", "name", "content"), none, recogniser).select("doc_id", "stem", "ocr") if recogniser else none
        pages = kept(sources.assembled(texts.where("status = 'done'").select("doc_id", "page", "text"), sources.with_ocr(shots, seen)), "pages")
        self._add("pictures", pictures.withColumn("batch", batch), subject, data_type)
        order = F.row_number().over(browse.Window.partitionBy("doc_id").orderBy("page"))
        chapter = F.abs(F.xxhash64("doc_id") % F.lit(1 << 30)) * F.lit(1 << 20)  # places of a chapter's pages follow one another
        self._add("pages", pages.withColumns({"pos": (chapter + order).cast("long"), "batch": batch}), subject, data_type)
        done = files.select("doc_id", "digest").join(pages.select("doc_id").distinct(), "doc_id", "left_semi")
        self._add("batches", done.select(batch.alias("batch"), "doc_id", "digest", F.current_timestamp().alias("made")).coalesce(1), subject, data_type)
        return texts.groupBy("doc_id").agg(F.max("status").alias("status"))

    # Scopes

    def _current(self, subject: str | None = None, data_type: str | None = None) -> DataFrame:
        """(subject, data_type, doc_id, batch, digest): of every file the batch that counts."""
        rows = self._table("batches", self.BATCHES, subject, data_type)
        return rows.groupBy("subject", "data_type", "doc_id").agg(F.max_by(F.struct("batch", "digest"), "made").alias("x")).select("subject", "data_type", "doc_id", "x.batch", "x.digest")

    def _listed(self, table: str, schema: str, subject: str | None = None, data_type: str | None = None) -> DataFrame:
        """A table without the rows of batches that do not count."""
        current = self._current(subject, data_type).drop("digest")
        return self._table(table, schema, subject, data_type).join(current, ["subject", "data_type", "doc_id", "batch"], "left_semi").drop("batch")

    def pages(self, subject: str, data_type: str) -> DataFrame:
        return self._listed("pages", self.PAGES, subject, data_type)

    def chapters(self, subject: str, data_type: str) -> DataFrame:
        """(ordinal, doc_id) in natural order."""
        checked(data_type, subject=subject)
        return scope.chapters(self.pages(subject, data_type))

    def merge(self, subject: str, data_type: str, pick: str | None = None, span: str | None = None) -> str:
        """Keeps the pages of some chapters as a scope; its name. Exactly one of pick and span."""
        if bool(pick) == bool(span):
            raise ValueError("give either a pick or a span")
        selection = scope.choose(self.chapters(subject, data_type), pick, span)
        stems = [r.doc_id for r in selection.orderBy("selected").select("doc_id").collect()]  # chapters chosen by hand
        given = self.spark.createDataFrame([(stems, pick, span)], "stems array<string>, pick string, span string")
        name = given.select(scope_name(F.col("stems"), F.col("pick"), F.col("span")).alias("n")).first().n.removesuffix(".jsonl")
        placed = scope.placed(scope.merged(self.pages(subject, data_type), selection).drop("subject", "data_type"))
        self._add("scopes", placed.withColumns({"scope": F.lit(name), "made": F.current_timestamp()}), subject, data_type)
        return name

    def scope_pages(self, subject: str, data_type: str, name: str) -> DataFrame:
        """The pages of a scope, else of the chapter of this name; fails if there are none."""
        checked(data_type, subject=subject, chapter=name)
        every = self._table("scopes", self.SCOPES, subject, data_type).where(F.col("scope") == name)
        last = every.agg(F.max("made").alias("made")).first().made  # a scope is as it was last merged
        rows = self.pages(subject, data_type).where(F.col("doc_id") == name) if last is None else every.where(F.col("made") == F.lit(last))
        if rows.isEmpty():
            raise FileNotFoundError(f"no scope or chapter {name}")
        return rows.select("doc_id", "page", "text", "images", "ocr", "pos")

    # Index and search

    def _index_path(self, subject: str, data_type: str, name: str) -> str:
        return self._path("index", subject, data_type, name)

    def build_index(self, subject: str, data_type: str, name: str) -> None:
        rows = sources.index_rows(self.scope_pages(subject, data_type, name))
        if rows.isEmpty():
            raise ValueError("no page has any text")
        path = self._index_path(subject, data_type, name)
        sources.write_index(rows.withColumn("embedding", embedded(F.col("text"), self.embedder)), path, subject, self.embedder.name)
        stored.build(search.with_blob(sources.read_index(self.spark, path)), f"{path}/search")

    def index(self, subject: str, data_type: str, name: str) -> DataFrame:
        checked(data_type, subject=subject, chapter=name)
        return sources.read_index(self.spark, self._index_path(subject, data_type, name))

    def search(self, subject: str, data_type: str, name: str, query: str, k: int = 5) -> DataFrame:
        """(rank, branch, score, doc_id, page): exact hits, else near ones."""
        checked(query=query)
        if k <= 0:
            raise ValueError("k has to be over 0")
        vector = [float(x) for x in self.embedder.encode([query])[0]]
        self.index(subject, data_type, name)  # checked
        return stored.StoredIndex(self.spark, f"{self._index_path(subject, data_type, name)}/search").search(query, vector, k)

    def ask(self, subject: str, data_type: str, name: str, questions: list[str], k: int = 15) -> DataFrame:
        """(query_id, question, answer, origin, cites) per question, numbered from 0."""
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
        return answers.answered(self.index(subject, data_type, name), asked, self.model, self.embedder, k, journal=self._journal())

    def _journal(self) -> Journal:
        return Journal(self.spark, self._path("journal"))

    # Keywords

    def make_tips(self, subject: str, data_type: str, name: str, lang: str = "cn", topn: int = 10, with_model: bool = False, refresh: bool = False) -> DataFrame:
        """Ranks and keeps the keywords of a scope's chapters; with_model: the model names allowed terms, again with refresh, and chooses among candidates."""
        checked(data_type, lang, subject=subject, chapter=name)
        pages = self.scope_pages(subject, data_type, name)
        rows = keywords.scored(pages, keywords.counted(pages, lang), lang)
        rows = keywords.promoted(rows).drop("place") if lang == "en" else rows
        ranked = kept(keywords.ranked(rows), "ranked")
        if with_model:
            allowed = listing.allowed_terms(pages, self.model, lang, journal=self._journal(), refresh=refresh)
            self._add("allowed", allowed.withColumns({"scope": F.lit(name), "lang": F.lit(lang)}), subject, data_type)
            ids = listing.chosen_ids(listing.candidates(ranked, pages), self.model, topn, lang, self._journal())
            ranked = listing.kept_and_filled(ranked, ids, topn)
        picked = keywords.selected(ranked, keywords.adaptive_limits(keywords.metrics(ranked), topn), lang)
        whole = keywords.with_norm(ranked).drop("rank", "raw_score", "tf", "page_df")
        rows = picked.join(whole, ["doc_id", "term"]).withColumns({"scope": F.lit(name), "lang": F.lit(lang), "made": F.current_timestamp()})
        self._add("tips", rows.select(*(c.split()[0] for c in self.TIPS.split(", "))), subject, data_type)
        return self.tips(subject, data_type, name, lang)

    def corpus_keywords(self, subject: str, data_type: str, lang: str = "cn", topn: int = 10) -> DataFrame:
        """The keywords of every chapter among all chapters of a corpus; only chapters that are new, changed or gone since the last call are counted."""
        checked(data_type, lang, subject=subject)
        held = counts.TermCounts(self.spark, self._path("counts", subject, data_type), lang)
        known = held.chapters().select("doc_id", F.col("mark").alias("batch"))
        current = self._current(subject, data_type).select("doc_id", "batch")
        new = kept(current.join(known, ["doc_id", "batch"], "left_anti"), "new")
        gone = kept(known.join(current, "doc_id", "left_anti").select("doc_id"), "gone")
        if not new.isEmpty():
            fresh = self._table("pages", self.PAGES, subject, data_type).join(new, ["doc_id", "batch"], "left_semi")
            held.add(fresh, F.col("batch"))
        if not gone.isEmpty():
            held.remove(gone)
        return held.keywords(topn)

    def _allowed(self, subject: str, data_type: str, name: str, lang: str) -> DataFrame:
        return self._table("allowed", self.ALLOWED, subject, data_type).where((F.col("scope") == name) & (F.col("lang") == lang)).select("doc_id", "terms")

    def tips(self, subject: str, data_type: str, name: str, lang: str = "cn") -> DataFrame:
        """The keywords of a scope as last made; allowed terms if there are none."""
        checked(data_type, lang, subject=subject, chapter=name)
        rows = self._table("tips", self.TIPS, subject, data_type).where((F.col("scope") == name) & (F.col("lang") == lang))
        last = rows.join(F.broadcast(rows.agg(F.max("made").alias("made"))), "made").drop("made")  # one row
        return listing.allowed_as_tips(self._allowed(subject, data_type, name, lang)) if listing.tips_empty(last) else last

    def keywords(self, subject: str, data_type: str, name: str, chapter: str | None = None, limit: int = 8, lang: str = "cn") -> DataFrame:
        """(doc_id, n, term, fallback): the first keywords of a chapter, for a search box."""
        tips = self.tips(subject, data_type, name, lang).select("doc_id", "rank", "term")
        return listing.shown(tips, self._allowed(subject, data_type, name, lang), chapter, limit)

    # Exams

    def make_exam(self, subject: str, data_type: str, name: str, n: int = 10, k: int = 5, lang: str = "auto", seed: int = 7) -> str:
        """Writes questions over a scope's index; the name of the file."""
        if n <= 0 or k <= 0:
            raise ValueError("n and k have to be over 0")
        made = exam.generated(self.index(subject, data_type, name), self.model, self.embedder, n, k, lang=lang, seed=seed, chapter=name)
        told = {"subject": subject, "data_type": data_type, "chapter": name, "lang": lang, "created_at": artifacts.time.strftime("%Y-%m-%dT%H:%M:%S"), "generator": {"retrieval": {"k": k, "max_ctx_chars": 6000, "ctx_per_doc_chars": 1200}, "llm": {"model": getattr(self.model, "model", type(self.model).__name__), "temperature": 0.0}}}
        file = f"exam_{artifacts.stamp_now()}.json"
        artifacts.write_json(self.spark, self._path("exams", subject, data_type, name, file), {"meta": told, "questions": made})
        return file

    def exams(self, subject: str, data_type: str, name: str) -> DataFrame:
        """(path, mtime) of the exams of a scope."""
        try:
            found = self.spark.read.format("binaryFile").load(self._path("exams", subject, data_type, name))
        except AnalysisException:
            return self.spark.createDataFrame([], "path string, mtime timestamp")
        return found.where("path LIKE '%.json'").select("path", F.col("modificationTime").alias("mtime"))

    def exam(self, subject: str, data_type: str, name: str, file: str | None = None) -> dict:
        """An exam, by default the latest."""
        checked(data_type, subject=subject, chapter=name)
        if file is None:
            last = browse.latest(self.exams(subject, data_type, name).withColumn("scope", F.lit(name)), ["scope"]).first()
            file = last.path.rsplit("/", 1)[-1] if last else ""
        text = artifacts.read_text(self.spark, self._path("exams", subject, data_type, name, file)) if file else None
        if text is None:
            raise FileNotFoundError(f"no exam of {name}")
        return json.loads(text)

    def delete_exam(self, subject: str, data_type: str, name: str, file: str) -> str:
        checked(data_type, subject=subject, chapter=name, file_name=file)
        return artifacts.delete_json(self.spark, self._path("exams", subject, data_type, name), file)

    # Browsing

    def materials(self) -> DataFrame:
        """(subject, data_type, chapters): of every corpus its scopes, else its chapters."""
        merged = self._table("scopes", self.SCOPES).select("subject", "data_type", F.col("scope").alias("chapter"), F.lit(0).alias("priority"))
        single = self._listed("pages", self.PAGES).select("subject", "data_type", F.col("doc_id").alias("chapter"), F.lit(1).alias("priority"))
        every = merged.unionByName(single).distinct()
        return browse.rollup(browse.first_source(every, ["subject", "data_type"], "priority"), ["subject", "data_type"], "chapter")

    def viewer_sources(self) -> DataFrame:
        """(subject, data_type, chapters): of every corpus its chapters, else its scopes."""
        single = self._listed("pages", self.PAGES).select("subject", "data_type", F.col("doc_id").alias("chapter"), F.lit(0).alias("priority"))
        merged = self._table("scopes", self.SCOPES).select("subject", "data_type", F.col("scope").alias("chapter"), F.lit(1).alias("priority"))
        every = single.unionByName(merged).distinct()
        return browse.rollup(browse.first_source(every, ["subject", "data_type"], "priority"), ["subject", "data_type"], "chapter")

    def upload_folders(self) -> DataFrame:
        """(subject, data_type, names, file_count) of what was taken in."""
        return browse.rollup(self.uploads(), ["subject", "data_type"], "name")

    def preprocess_candidates(self) -> DataFrame:
        """(subject, data_type, doc_ids, file_count) of the files without pages."""
        files = self.uploads().select("subject", "data_type", documents.stem(F.col("name")).alias("doc_id"))
        return browse.rollup(ingest.pending(files, self._listed("pages", self.PAGES), ["subject", "data_type", "doc_id"]), ["subject", "data_type"], "doc_id")

    def index_candidates(self) -> DataFrame:
        """(subject, data_type, chapters, file_count) of the indexes, which can be searched and examined."""
        try:
            found = self.spark.read.json(self._path("index", "*", "*", "*", "info"))
        except AnalysisException:
            found = self.spark.createDataFrame([], "subject string, output_dir string")
        tail = r"/index/[^/]+/([^/]+)/([^/]+)$"
        return browse.rollup(found.select("subject", F.regexp_extract("output_dir", tail, 1).alias("data_type"), F.regexp_extract("output_dir", tail, 2).alias("chapter")), ["subject", "data_type"], "chapter")

    def generated_tips(self, lang: str = "cn") -> DataFrame:
        """(subject, data_type, scopes) that have keywords in a language."""
        checked(lang=lang)
        rows = self._table("tips", self.TIPS).where(F.col("lang") == lang).select("subject", "data_type", "scope").distinct()
        return browse.rollup(rows, ["subject", "data_type"], "scope").drop("file_count")

    def generated_exams(self) -> DataFrame:
        """(subject, data_type, chapter, paths, file_count) of the exams."""
        try:
            found = self.spark.read.format("binaryFile").load(self._path("exams", "*", "*", "*"))
        except AnalysisException:
            found = self.spark.createDataFrame([], "path string")
        tail = r"/exams/([^/]+)/([^/]+)/([^/]+)/([^/]+\.json)$"
        parts = found.where(F.col("path").rlike(tail)).select(*(F.regexp_extract("path", tail, k).alias(c) for k, c in enumerate(("subject", "data_type", "chapter", "path"), 1)))
        return browse.rollup(parts, ["subject", "data_type", "chapter"], "path")

    def page_keys(self, subject: str, data_type: str, name: str) -> DataFrame:
        return browse.page_keys(self.scope_pages(subject, data_type, name))

    def page(self, subject: str, data_type: str, name: str, doc_id: str | None = None, page: int | None = None) -> DataFrame:
        """A page with the numbers of its neighbours; fails if there is none."""
        rows = self.scope_pages(subject, data_type, name)
        found = browse.page_lookup(rows, doc_id, page)
        if found.isEmpty():
            raise FileNotFoundError("no such page")
        return found.join(browse.neighbours(rows), ["doc_id", "page"], "left")

    def image_url(self, image: str) -> str:
        """The address of an image, by its path or name; fails if there is none."""
        checked(image=image)
        there = self._listed("pictures", self.PICTURES).select(F.concat_ws("/", "subject", "data_type", "doc_id", F.lit("raw_img"), "name").alias("path"))
        found = browse.resolved_images(self.spark.createDataFrame([(image.strip(),)], "image string"), there).select(static_url(F.col("path")).alias("url")).first()
        if found is None:
            raise FileNotFoundError(f"no image {image}")
        return found.url
