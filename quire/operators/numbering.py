"""Gapless positions without a single task that sees all rows.

Rows are dealt out by ranges of their order and sorted in each, and written with
the number of their range and their place in it. How many rows each range has is
a sum per range; how many stand before it follows from these few numbers.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def numbered(rows: DataFrame, order: list[Column], name: str = "position", ranges: int | None = None) -> DataFrame:
    """rows with `name`, from 0 in the given order; equal rows have numbers in some order, which is fixed by writing them once."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = kept(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = dict(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    firsts = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=-1))), initial=0))
    before = spark.createDataFrame(list(enumerate(firsts)), "_range int, _first long")
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def running(rows: DataFrame, group: str, order: list[Column], name: str = "rank", weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """rows with `name`, the number of rows of their group up to them, themselves included, or the sum of a weight over these.

    A group may hold most rows: it is dealt out by ranges of its order like all others. How much of a group stands in
    each of its ranges is a row a range, so the sums before a range are small tables, which stay on the executors.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = kept(dealt.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "running")
    if weight:
        placed = placed.withColumn("_sum", F.sum(weight).over(Window.partitionBy("_range", group).orderBy("_place")))
    held = placed.groupBy("_range", F.col(group).alias("_group")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_held"), F.min("_place").alias("_low"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).withColumnRenamed("_range", "_of").drop("_held")
    joined = placed.join(held, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    inside = F.col("_sum") if weight else F.col("_place") - F.col("_low") + 1
    return joined.withColumn(name, F.col("_before") + inside).drop("_range", "_place", "_of", "_group", "_low", "_before", "_sum")
