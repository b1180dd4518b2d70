"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stage_table


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours to the least of them and itself: the smaller ones (small star) or the larger ones (large star).

    pairs has u and v. The least neighbour comes from an aggregation with partial results, is written, and goes back by a join on
    u. Both sides of that join are tables, so Spark splits its skewed partitions: no task gathers the neighbours of a node."""
    least = stage_table(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = pairs.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").unionByName(least.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), "m")
    return out.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node of edges (a, b: long). Self-links are left out.

    Each round writes its table to the shared folder; the number of rounds grows with the logarithm of the longest chain."""
    pairs = stage_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage_table(_stars(both, small=False), "large")
        after = stage_table(_stars(large, small=True), "small")
        drop_table(large)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0]:
            drop_table(pairs)
        pairs = after
        if now == state or not now[0]:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
