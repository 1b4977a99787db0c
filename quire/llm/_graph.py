"""Connected components by alternating star contractions.

Each round links every node's larger neighbours to its smallest one, then its
smaller ones; rounds are grouped minima and joins, and each is kept in the
shared folder, so neither links nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs: (u, v) with u > v, distinct. Links v's of each u that are larger (or not larger) than u to the smallest of u and its neighbours."""
    if larger:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    if larger:  # one node can have most of the others as neighbours: from a kept table, the join can split them
        low = keep(low, "least")
    moved = both.join(low, "u")
    if larger:
        linked = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in a pair, its component named by the smallest node. Self-pairs and nulls are ignored."""
    now = keep(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        last, now = now, keep(_stars(_stars(now, True), False), "links")
        if now.count() == last.count() and now.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
