"""Replies of a model, written once and read by whatever follows.

A reply is kept under the hash of the model's name, the two prompts and the number of
tokens. Prompts that have a reply are not asked again, in this run or a later one.
The others are asked in rounds of a bounded number, each written when it is done, so
that what is lost with a job is a round at most. Failed calls are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..providers import LanguageModel
from ..sources.scratch import new_path, written

#: Prompts of a round, and of a task in it.
ROUND, TASK = 100_000, 200
SCHEMA = "key string, reply string, failed boolean, made timestamp"


def model_name(model: LanguageModel) -> str:
    return str(getattr(model, "model", "") or type(model).__name__)


def _caller(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, failed = [], []
            for _, system, user, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    replies.append((model.complete(system, user, int(tokens)) or "").strip())
                    failed.append(False)
                except Exception:  # noqa: BLE001  a failed call is an answer that cannot be used
                    replies.append("")
                    failed.append(True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string()), pa.array(failed)], names=["key", "reply", "failed"])

    return run


class Journal:
    """The replies below a path; without one, those of this object alone."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "journal")

    def replies(self) -> DataFrame:
        """SCHEMA; empty if nothing was ever asked."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def asked(self, rows: DataFrame, system: Column, user: Column, tokens: Column, model: LanguageModel, name: str = "reply", refresh: bool = False) -> DataFrame:
        """rows, written with `name`: the reply to the prompts of each row, empty where the call failed. refresh: ask all again, and keep the new replies beside the old."""
        spark = self.spark
        told = F.sha2(F.concat_ws("\x1f", F.lit(model_name(model)), system, user, tokens.cast("string")), 256)
        rows = written(rows.withColumns({"_key": told, "_system": system, "_user": user, "_tokens": tokens}), new_path(spark, "asked"))
        prompts = rows.groupBy(F.col("_key").alias("key")).agg(*(F.first(f"_{c}").alias(c) for c in ("system", "user", "tokens")))
        known = self.replies().where("NOT failed")
        known = known.limit(0) if refresh else known
        missing = written(prompts.join(known.select("key"), "key", "left_anti"), new_path(spark, "missing"))
        n = missing.count()
        rounds = -(-n // ROUND)
        for k in range(rounds):
            part = missing if rounds == 1 else missing.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
            part = part.repartition(max(1, min(n, ROUND) // TASK), "key").mapInArrow(_caller(model), "key string, reply string, failed boolean")
            part.withColumn("made", F.current_timestamp()).write.mode("append").parquet(self.path)
        if rounds:
            known = self.replies().where("NOT failed")
        every = known.groupBy("key").agg(F.max_by("reply", F.struct("made", "reply")).alias("reply"))  # the last, if it was asked more than once
        joined = rows.join(every, F.col("_key") == F.col("key"), "left").withColumn(name, F.coalesce("reply", F.lit("")))
        return written(joined.drop("_key", "_system", "_user", "_tokens", "key", *(["reply"] if name != "reply" else [])), new_path(spark, "replied"))
