"""Connected components of an edge table, by star contraction over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable.

    Each round hangs every node's larger neighbours under its smallest neighbour (large star), then
    the smaller neighbours too (small star), until nothing changes; the number of rounds grows with
    the logarithm of the longest chain. Each round is a written table, so a lost executor costs no
    recomputation, and minima are combined before they are shuffled. Self loops and repeated
    edges are harmless; no edges give no rows.
    """
    stars = durable(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
                    .filter("node <> root").distinct(), "stars")
    before = None
    while True:
        # Large star: both directions; larger neighbours meet the smallest of the neighbourhood.
        both = stars.union(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = durable(both.groupBy("node").agg(F.min("root").alias("least"))
                        .select("node", F.least("node", "least").alias("least")), "least")
        large = both.filter("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        large = durable(large.distinct(), "large")
        # Small star: each node and its smaller neighbours meet the smallest of them.
        low = durable(large.groupBy("node").agg(F.min("root").alias("least")), "low")
        small = large.join(low, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).filter("node <> root")
        stars = durable(small.union(low.select("node", F.col("least").alias("root"))).distinct(), "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.union(roots)
