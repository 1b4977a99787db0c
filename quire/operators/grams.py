"""Exact search over a stored index of the grams of pages.

The index has three tables below a path: the pages with their normal form
(`blob`), sorted by position; postings, lists of the positions of a block of pages
that have a gram, in folders by a hash of the gram and sorted by it; and the
grams with the number of pages that have each.

A search reads the counts of its own grams, then the postings of the rarest of
each variant, and intersects their positions. The pages that remain are looked at
in windows, in the order in which they would be ranked, until k are found to
hold the variant. Windows end at MOST candidates: where grams name many pages
that do not hold the query, the blobs are read once instead. A blob ends
with END_MARK, so a variant shorter than a gram is on a page exactly if a gram
of the page begins with it, and its postings are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

GRAM = 3
#: Folders of postings; grams of a variant that are intersected; pages that are looked at first, how many times more after that, and the most in a further window.
FOLDERS, RAREST, WINDOW, GROWTH, MOST = 16, 8, 64, 8, 1000
#: Characters of blobs in one block of postings.
BLOCK = 2 << 20
END_MARK = "\x00" * (GRAM - 1)
_POSTING = "gram string, first long, positions array<long>"


def grams(blob: str) -> set[str]:
    return {blob[k : k + GRAM] for k in range(len(blob) - GRAM + 1)}


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[int]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        names = sorted(held)
        lists = [sorted(held[g]) for g in names]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x[0] for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["gram", "first", "positions"])

    for batch in batches:
        for pos, blob in zip(batch.column("pos").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if pos is None or blob is None:
                continue
            for gram in grams(blob + END_MARK):
                held.setdefault(gram, []).append(pos)
            size += len(blob)
            if size >= BLOCK:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def _folder():
    return F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")


def _folder_of(gram: str) -> int:
    """_folder() of one gram on the driver."""
    value = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (value - (1 << 64) if value >> 63 else value) % FOLDERS


def build(pages: DataFrame, path: str) -> None:
    """Writes the index of pages with a position `pos`, which is theirs alone, and a normal form `blob` (search.with_blob)."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages.repartitionByRange(n, "pos").sortWithinPartitions("pos").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/pages")
    found = spark.read.parquet(f"{path}/pages").select("pos", "blob").mapInArrow(_postings, _POSTING).withColumn("folder", _folder())
    found = found.repartition(n, "folder", F.pmod(F.xxhash64("first"), F.lit(4)))  # the lists of a gram that all pages have go to several tasks
    found.sortWithinPartitions("folder", "gram", "first").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    counts = spark.read.schema(f"{_POSTING}, folder int").parquet(f"{path}/postings").groupBy("folder", "gram").agg(F.sum(F.size("positions")).cast("long").alias("n_pages"))
    counts.repartition(n, "folder").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/grams")


class GramIndex:
    """A built index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.pages = spark.read.parquet(f"{path}/pages")
        self._lists = spark.read.schema(f"{_POSTING}, folder int").parquet(f"{path}/postings")
        self._counts = spark.read.schema("gram string, n_pages long, folder int").parquet(f"{path}/grams")

    def _of(self, rows: DataFrame, wanted: list[str]) -> DataFrame:
        """The rows of some grams: only their folders are read, and of these only what their statistics leave."""
        folders = {_folder_of(g) for g in wanted}
        return rows.where(F.col("folder").isin(sorted(folders)) & F.col("gram").isin(wanted))

    def _rarest(self, variants: list[str]) -> dict[str, list[str]]:
        """Of each variant, the grams to intersect; none for one with a gram that no page has."""
        own = {v: sorted(grams(v)) for v in variants if len(v) >= GRAM}
        every = sorted({g for gs in own.values() for g in gs})
        counts = {r.gram: r.n_pages for r in self._of(self._counts, every).select("gram", "n_pages").collect()} if every else {}  # the grams of the query
        return {v: sorted(gs, key=lambda g: (counts[g], g))[:RAREST] for v, gs in own.items() if all(g in counts for g in gs)}

    def candidates(self, variants: list[str]) -> DataFrame:
        """(variant, pos, sure): pages that have the rarest grams of a variant, by its place; sure if that proves that they hold it."""
        out = self.spark.createDataFrame([], "variant int, pos long, sure boolean")
        chosen = self._rarest(variants)
        for at, v in enumerate(variants):
            if len(v) < GRAM:
                found = self._lists.where(F.col("gram").startswith(v)).select(F.explode("positions").alias("pos")).distinct()
            elif v in chosen:
                found = self._of(self._lists, chosen[v]).select("gram", F.explode("positions").alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen[v]))
            else:
                continue
            out = out.unionByName(found.select(F.lit(at).alias("variant"), "pos", F.lit(len(v) <= GRAM and "\x00" not in v).alias("sure")))
        return out

    def exact_search(self, query: str, k: int = 15) -> DataFrame:
        """The rows of search.exact_search.

        The driver gets a window of candidates at most, and texts of hits alone. Where windows up to MOST hold no k hits, grams
        say little about the query; what is left would touch most files, so the executors look at all blobs once.
        """
        variants = search.driver_variants(query)
        named = self.candidates(variants).persist()
        hits: dict[tuple, int] = {}
        after, window = None, max(WINDOW, 2 * k)
        while variants and len(hits) < k:
            if after is not None and window > MOST:
                hits = {(r.doc_id, r.page): r.pos for r in self._scan(variants, k).collect()}  # k at most
                break
            rest = named if after is None else named.where((F.col("variant") > after[0]) | (F.col("variant") == after[0]) & (F.col("pos") > after[1]))
            some = rest.orderBy("variant", "pos").limit(window).collect()  # `window` at most
            for page in self._held(some, variants) if some else ():
                if len(hits) < k:
                    hits.setdefault((page.doc_id, page.page), page.pos)
            if len(some) < window:
                break
            after, window = (some[-1].variant, some[-1].pos), GROWTH * window
        named.unpersist()
        kinds = {f.name: f.dataType.simpleString() for f in self.pages.schema}
        texts = {r.pos: r for r in self._at(list(hits.values())).select("pos", "text", "ocr").collect()} if hits else {}  # k at most
        rows = [(rank + 1, 1.0, *page, pos, texts[pos].text, texts[pos].ocr) for rank, (page, pos) in enumerate(hits.items())]
        return self.spark.createDataFrame(rows, f"rank int, score double, doc_id {kinds['doc_id']}, page {kinds['page']}, pos {kinds['pos']}, text {kinds['text']}, ocr {kinds['ocr']}")

    def _at(self, places: list[int]) -> DataFrame:
        """The pages at some positions."""
        return self.pages.where(F.expr(f"pos BETWEEN {min(places)} AND {max(places)} AND pos IN ({', '.join(map(str, sorted(set(places))))})"))  # one text, not a literal each

    def _held(self, some: list, variants: list[str]) -> list:
        """The named pages that hold the variant, in order, without their texts."""
        needs = {r.variant for r in some if not r.sure}
        tests = [F.contains("blob", F.lit(variants[v])).alias(f"v{v}") for v in sorted(needs)]
        found = {r.pos: r for r in self._at([r.pos for r in some]).select("doc_id", "page", "pos", *tests).collect()}
        return [found[r.pos] for r in some if r.sure or found[r.pos][f"v{r.variant}"]]

    def _scan(self, variants: list[str], k: int) -> DataFrame:
        """(doc_id, page, variant, pos) of the first k hits among all pages; of a page no more than that is moved."""
        at = F.coalesce(*(F.when(F.contains("blob", F.lit(v)), n) for n, v in enumerate(variants)))
        hits = self.pages.select("doc_id", "page", "pos", at.alias("variant")).where("variant IS NOT NULL AND pos IS NOT NULL")
        best = hits.groupBy("doc_id", "page").agg(F.min(F.struct("variant", "pos")).alias("h"))
        return best.select("doc_id", "page", "h.*").orderBy("variant", "pos").limit(k)
