"""Connected components of a graph kept in frames: union-find by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of edges u, v that are not least themselves.

    Only a count and a checksum of the edges come to the driver in each round; the number of rounds grows with the
    logarithm of the longest chain.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        oriented = staged(oriented, "components")
        sums = oriented.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if seen == tuple(sums) or not sums.n:
            return oriented.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(sums)
        oriented = _small_star(_large_star(oriented).where("u <> v").distinct())
