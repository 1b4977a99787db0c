"""Searches over a stored index: grams for exact hits, cells for near ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cells, grams, search
from .search import MIN_SIMILARITY

#: The columns of a vector hit.
HIT = ("pos", "doc_id", "page")


def build(index: DataFrame, path: str, n_cells: int | None = None) -> None:
    """Writes the index of pages (doc_id, page, pos, text, ocr, blob, embedding), each with a position of its own."""
    grams.build(index.drop("embedding"), f"{path}/grams")
    cells.build(index.select(*HIT, "embedding"), f"{path}/cells", n_cells)


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.grams, self.cells = grams.GramIndex(spark, f"{path}/grams"), cells.CellIndex(spark, f"{path}/cells")

    def exact_search(self, query: str, k: int = 15) -> DataFrame:
        return self.grams.exact_search(query, k)

    def vector_search(self, vector: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
        """(rank, score, doc_id, page) of the nearest rows."""
        near = self.cells.search(vector, k, min_similarity)
        return search.ranked_hits(near) if near is not None else self.grams.exact_search("").select("rank", "score", "doc_id", "page")

    def hybrid_search(self, query: str, vector: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
        """Exact hits before near ones, as search.hybrid_search."""
        return search.merged_hits(self.exact_search(query, k), self.vector_search(vector, k, min_similarity), k)

    def search(self, query: str, vector: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
        """Exact hits if there are any, else near ones, as search.search; near ones are only looked for in that case."""
        exact = self.exact_search(query, k)
        none = exact.limit(0).select("rank", "score", "doc_id", "page")
        near = self.vector_search(vector, k, min_similarity) if exact.isEmpty() else none
        return search.merged_hits(exact, near, k)
