"""Connected components of a link table by alternating stars, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with `least`: the smallest of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    # dealt anew, so that the pairs of a hub can be split among tasks
    return pairs.join(least.repartition("u"), "u").withColumn("least", F.least("u", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    return near.select("v", "least").union(near.select(F.col("u").alias("v"), "least")).where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every linked node, root being the smallest node of its component; unlinked nodes have no row.

    Self-links, repeated links, links with a null and empty tables need no preparation. The number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = materialise(links.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna().where("u <> v").distinct())
    mark = None
    while True:
        edges = materialise(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
