"""The corpus pipeline: quality, exact and near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns rows with the columns of documents; the last returns the
pieces of packed sequences. Between stages rows are written as Parquet to the
shared folder and read again.

run removes what a stage wrote once its rows are kept, and at the end all but what
its result reads, so results of several runs can be read side by side, late, and
from several threads. Where a caller writes and rereads the rows of each stage
itself, a stage removes what the ones before it left in the same sequence: those
called on the same tables, in the same thread, since the first stage.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import _store, decontam, exact_dedup, packing, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class Step:
    """A stage; its plain function is `apply`."""

    #: Of each thread: the tables and the stage of the last call, and what the sequence has left so far.
    _last = threading.local()

    def __init__(self, apply: Stage):
        self.apply = apply
        self.__name__, self.__doc__ = apply.__name__, apply.__doc__

    def __call__(self, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        at = next(k for k, (_, step) in enumerate(STAGES) if step is self)
        tables, before = getattr(self._last, "call", (None, 0))
        same = tables == sf_dir and 0 < at and before <= at
        if same:
            _store.cleanup(spark, self._last.left, read_by=docs)
        with _store.noted() as wrote:
            out = self.apply(spark, docs, sf_dir)
        self._last.call, self._last.left = (sf_dir, at), (self._last.left if same else []) + wrote
        return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@Step
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    return quality.filtered(docs, _table(spark, sf_dir, "labels"))


@Step
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.deduplicated(docs)


@Step
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 or more in five-word shingles, one document: that with the smallest id."""
    return simhash.similar_deduplicated(docs)


@Step
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontam.cleaned(docs, _table(spark, sf_dir, "benchmark"))


@Step
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned weights and tokenizer ids are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs, left = _table(spark, sf_dir, "documents"), []
    for k, (name, step) in enumerate(STAGES):
        with _store.noted() as wrote:
            docs = step.apply(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = _store.keep(docs, name.replace(" ", "-"))
        left += wrote
        _store.cleanup(spark, left, read_by=docs)
    return docs
