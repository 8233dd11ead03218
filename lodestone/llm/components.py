"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and joins, so a node with very many links is pre-aggregated before the shuffle and its
join is split by adaptive execution. Steps are written to the shared folder; the number of steps grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hang each node's larger (or all) neighbours on the smallest node among itself and its neighbours."""
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = ways.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = ways.join(least, "a")
    if both_ways:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links``: a, b (bigint). Returns node, root for every node that has a link; root is the smallest node reached."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    pairs = written(pairs, "links")
    before = None
    for _ in range(rounds):
        pairs = written(_star(_star(pairs, True), False), "links")
        # Every step lowers some parent until all hang on their roots.
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
