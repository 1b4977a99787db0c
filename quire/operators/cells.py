"""Vector search over a stored index of cells, exact by bounds.

Centres are fitted on a bounded sample (SAMPLE); every row is indexed, under
its nearest centre and with its distance to it. For a row x of a cell with centre c,
q.x = q.c + q.(x - c), which is at most q.c + |q| |x - c|. So a cell whose radius
cannot lift its centre to the k-th score so far is not read, and of the others only
rows that are far enough from their centre are multiplied. Distances and bounds are
widened by SLACK, which covers rounding; the answer is that of a scan of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import search
from .search import MIN_SIMILARITY

#: Rows that centres are fitted on, rounds of fitting, and the most centres.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
SLACK = 1e-6
#: Ways into which the hits of a query go before their last merge.
WAYS = 16


def fitted(index: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of a sample of the embeddings: rows with the smallest hashes of their position, so that a rerun gives the same."""
    some = index.where("embedding IS NOT NULL").select("embedding", F.xxhash64("pos", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE)
    rows = np.array([r.embedding for r in some.select("embedding").collect()], np.float64)  # SAMPLE at most
    if not len(rows):
        return np.zeros((0, 0))
    n = min(cells or int(len(rows) ** 0.5), MOST_CELLS, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = _nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        sizes = np.bincount(own, minlength=n)[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest centre, and the distance to it."""
    own = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, 1)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(index: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes the cells of an index (pos, embedding and other columns); rows without an embedding are left out."""
    spark = index.sparkSession
    centres = fitted(index, cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = _nearest(_vectors(batch.column("embedding")), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far + SLACK)], names=[*batch.schema.names, "cell", "far"])

    rows = index.where("embedding IS NOT NULL")
    placed = rows.mapInArrow(assign, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, far double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.repartition(n, "cell", F.pmod(F.xxhash64("pos"), F.lit(4)))  # a cell of a third of all rows goes to several tasks
    spread.sortWithinPartitions("cell", "far").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    radii = dict(spark.read.schema("far double, cell int").parquet(f"{path}/rows").groupBy("cell").agg(F.max("far").alias("r")).collect()) if len(centres) else {}  # a row a cell
    told = [(k, [float(x) for x in c], radii[k]) for k, c in enumerate(centres) if k in radii]
    spark.createDataFrame(told, "cell int, centre array<double>, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


class CellIndex:
    """A built index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        told = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        self.cells = np.array([r.cell for r in told], np.int64)
        self.centres = np.array([r.centre for r in told], np.float64).reshape(len(told), -1 if told else 0)
        self.radii = np.array([r.radius for r in told], np.float64)
        self.rows = spark.read.parquet(f"{path}/rows") if told else None

    def _reach(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of each cell, the score of its centre and the most that a row can have; and the length of the query."""
        length = float(np.linalg.norm(query)) + SLACK
        score = self.centres @ query
        return score, score + length * self.radii + SLACK, length

    def search(self, query: list[float], k: int = 15, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame | None:
        """The rows of search.vector_search, with their cell; None if nothing is indexed.

        The cells that can score highest are read first; from their k-th score follows which others are read, and which of their rows.
        """
        if self.rows is None:
            return None
        q = np.array(query, np.float64)
        score, most, length = self._reach(q)
        order = np.argsort(-most, kind="stable")
        first = order[: max(1, len(order) // 32)]
        least = -np.inf if min_similarity is None else min_similarity
        read = self.rows.where(F.col("cell").isin(self.cells[first].tolist()))
        some = search.vector_search(read, query, k, min_similarity).select("score").collect()  # k at most
        least = max(least, min(r.score for r in some)) if len(some) == k else least
        wanted = [c for c in order if most[c] >= least]
        if not wanted:
            wanted = order[:1].tolist()
        centre = F.element_at(F.create_map(*(F.lit(x) for c in wanted for x in (int(self.cells[c]), float(score[c])))), F.col("cell"))
        near = self.rows.where(F.col("cell").isin([int(self.cells[c]) for c in wanted]))
        near = near if least == -np.inf else near.where(F.col("far") * length + centre + SLACK >= least)
        return search.vector_search(near, query, k, min_similarity)

    def search_batch(self, queries: DataFrame, k: int = 10, min_similarity: float | None = MIN_SIMILARITY) -> DataFrame:
        """The rows of search.vector_search_batch (query_id, rank, pos, score); a task passes on k rows a query at most."""
        kind = queries.schema["query_id"].dataType
        schema = f"query_id {kind.simpleString()}, pos long, score double"
        out = self.spark.createDataFrame([], f"{schema}, rank int")
        for block in search.query_blocks(queries.select("query_id", "vector"), "query_id"):
            stated = block.where("vector IS NOT NULL").collect()  # search.QUERY_BLOCK at most
            if not stated or self.rows is None:
                continue
            vectors = np.array([r.vector for r in stated], np.float64)
            lengths = np.linalg.norm(vectors, axis=1) + SLACK
            least = np.full(len(stated), -np.inf if min_similarity is None else min_similarity)
            scores = vectors @ self.centres.T
            given = (vectors, lengths, scores, self.cells, [r.query_id for r in stated], kind, k)
            heads = np.unique((scores + lengths[:, None] * self.radii).argmax(1))
            first = self.rows.where(F.col("cell").isin(self.cells[heads].tolist())).select("cell", "far", "pos", "embedding").mapInArrow(_matcher(*given, least), schema)
            place = {r.query_id: i for i, r in enumerate(stated)}
            for r in _best(first, k).where(F.col("rank") == k).collect():  # one row a query
                least[place[r.query_id]] = max(least[place[r.query_id]], r.score - SLACK)
            able = (scores + lengths[:, None] * self.radii + SLACK >= least[:, None]).any(0)
            near = self.rows.where(F.col("cell").isin(self.cells[able].tolist())).select("cell", "far", "pos", "embedding")
            out = out.unionByName(_best(near.mapInArrow(_matcher(*given, least), schema), k))
        return out


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, first in each of several ways."""
    order = [F.desc(F.round("score", 9)), F.col("pos")]
    parts = hits.withColumn("way", F.pmod(F.xxhash64("pos"), F.lit(WAYS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "way").orderBy(*order))).where(F.col("rank") <= k).drop("way", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def _matcher(vectors: np.ndarray, lengths: np.ndarray, scores: np.ndarray, cells: np.ndarray, ids: list, kind, k: int, least: np.ndarray):
    """The k best rows of a task for each query, held in arrays that never grow past 2 k."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(c): i for i, c in enumerate(cells)}
        bound = least.copy()
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            own = batch.column("cell").to_numpy()
            far, pos = batch.column("far").to_numpy(), batch.column("pos").to_numpy()
            rows = _vectors(batch.column("embedding"))
            for cell in np.unique(own):
                at = np.flatnonzero(own == cell)
                most = far[at].max()
                for q in np.flatnonzero(scores[:, place[int(cell)]] + lengths * most + SLACK >= bound):
                    near = at[scores[q, place[int(cell)]] + lengths[q] * far[at] + SLACK >= bound[q]]
                    found = rows[near] @ vectors[q]
                    good = found >= bound[q]
                    if good.any():
                        s, p = np.concatenate([held[q][0], found[good]]), np.concatenate([held[q][1], pos[near[good]]])
                        if len(s) > k:
                            order = np.lexsort((p, -np.round(s, 9)))[:k]
                            s, p = s[order], p[order]
                            bound[q] = max(bound[q], s.min() - SLACK)
                        held[q] = s, p
        sizes = [len(s) for s, _ in held]
        if sum(sizes):
            which = np.repeat(np.arange(len(ids)), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow).take(pa.array(which)), pa.array(np.concatenate([p for _, p in held])), pa.array(np.concatenate([s for s, _ in held]))], names=["query_id", "pos", "score"])

    return run
