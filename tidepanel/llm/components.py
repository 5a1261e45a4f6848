"""Connected components of a graph given as pairs of longs, by stars: links move to ever smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import pinned

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that occurs in ``links`` (a, b); root is the smallest node that can be reached.

    Every step is a grouped minimum and a join of narrow rows; no component is
    ever gathered. Each round is written to the shared folder, which also cuts
    the lineage. Rounds grow with the logarithm of the longest path.
    """
    edges = pinned(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        # Large star: the larger neighbours of a node are tied to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "__a")
        large = both.filter("b > a").join(least, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pinned(large.filter("a <> b").distinct())
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least.withColumnRenamed("a", "__a"), F.col("a") == F.col("__a"))
        small = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = pinned(small.distinct())
    raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
