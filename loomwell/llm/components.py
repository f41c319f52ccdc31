"""Connected components of an edge table by alternating large and small stars.

Every round links each node's neighbours to the smallest of them, by aggregation and joins alone, and is written to the
shared folder. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.scratch import drop_saved, saved

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every larger neighbour of a node is linked to the smallest of the node and its neighbours; edges may repeat."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """node, class (the smallest node that can be reached), for all nodes of the links (a, b). No links: an empty table."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _mark(edges)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        last, edges = edges, saved(_small_star(_large_star(edges)), "edges")
        drop_saved(last)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"the classes have not settled in {MOST_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    classes = saved(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct(), "classes")
    drop_saved(edges)
    return classes
