"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is its smallest node.

    Each round halves the depth of every tree at least, so rounds grow with the logarithm of the longest
    chain. Minima are combined before they are shuffled and hubs are plain skewed joins. An empty table of
    edges gives an empty table; loops and repeated edges change nothing. Rounds end at a fixed point; if
    max_rounds is not enough an error is raised rather than a partial answer returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    before = _signature(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, e = e, stored(small.distinct(), "edges")
        discard(old)
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return root.union(e.select("v", "v").distinct())
