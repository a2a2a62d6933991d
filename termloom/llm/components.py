"""Connected components of an edge table, as DataFrame rounds with reliable checkpoints.

Alternates large-star and small-star rounds: every round is two aggregations that combine before they
shuffle, and ends in a checkpoint. Neither edges nor labels come to the driver, only their count and a sum.
Null ends, loops and repeated edges are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge (columns u, v: long): the least id that edges reach."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (count, total) == sign or not count:
            break
        sign = (count, total)
        now = cut(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
