"""Bipartite and citation graphs as edge tables; small-graph measures on the driver are bounded by a top-n subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a subgraph that small-graph measures take at most; they are chosen by degree, as the measure asks for.
SMALL = 100


def bipartite(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.select(left, right).filter(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()


def degree(edges: DataFrame, node: str) -> DataFrame:
    return edges.groupBy(node).agg(F.count(F.lit(1)).alias("degree"))


def projection(edges: DataFrame, node: str, by: str) -> DataFrame:
    """a, b, weight: how many neighbours two nodes share, a < b."""
    return edges.withColumnRenamed(node, "a").join(edges.withColumnRenamed(node, "b"), by).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def density(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nodes, edges, density of an undirected graph without loops."""
    nodes = edges.select(F.col(a).alias("x")).union(edges.select(b)).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    n = edges.agg(F.count(F.lit(1)).alias("edges")).join(nodes, F.lit(True))
    return n.select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")).alias("density"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles, clustering. edges: a < b, distinct. Edges go from the node of less degree, which bounds the joins."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    e = edges.join(deg.withColumnRenamed("d", "da"), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct(F.col("da"), F.col("a")) < F.struct(F.col("db"), F.col("b"))
    e = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedge = e.alias("x").join(e.select("s", F.col("t").alias("v")).alias("y"), "s").filter("t < v").select("s", "t", "v")
    closed = wedge.join(edges.select(F.col("a").alias("t"), F.col("b").alias("v")), ["t", "v"])
    n = closed.select(F.explode(F.array("s", "t", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = deg.withColumnRenamed("a", "node").join(n, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.select("node", "triangles", F.coalesce(F.try_divide(2.0 * F.col("triangles"), (F.col("d") * (F.col("d") - 1)).cast("double")), F.lit(0.0)).alias("clustering"))


def top_subgraph(edges: DataFrame, n: int = SMALL) -> DataFrame:
    """Edges among the n nodes of most degree, ties by node."""
    both = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    top = both.groupBy("node").agg(F.count(F.lit(1)).alias("d")).orderBy(F.desc("d"), "node").limit(n).select("node")
    return edges.join(top.withColumnRenamed("node", "a"), "a", "left_semi").join(top.withColumnRenamed("node", "b"), "b", "left_semi")


def small_measures(edges: DataFrame, n: int = SMALL) -> DataFrame:
    """node, betweenness, community of the top-n subgraph, in one task: shortest paths, and greedy merging by modularity."""
    import pandas as pd

    def measure(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        near: dict = {}
        for a, b in zip(f["a"], f["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        nodes = sorted(near)
        between = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            order, paths, far, parents, queue = [], {s: 1.0}, {s: 0}, {s: []}, deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for w in sorted(near[v]):
                    if w not in far:
                        far[w], paths[w], parents[w] = far[v] + 1, 0.0, []
                        queue.append(w)
                    if far[w] == far[v] + 1:
                        paths[w] += paths[v]
                        parents[w].append(v)
            load = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in parents[w]:
                    load[v] += paths[v] / paths[w] * (1 + load[w])
                if w != s:
                    between[w] += load[w]
        m, scale = len(f), max(1, (len(nodes) - 1) * (len(nodes) - 2))
        groups = {v: {v} for v in nodes}
        links = lambda x, y: sum(len(near[v] & groups[y]) for v in groups[x])
        total = lambda x: sum(len(near[v]) for v in groups[x])
        while True:
            best = max(((links(x, y) / m - total(x) * total(y) / (2 * m * m), x, y) for x in groups for y in groups if x < y and links(x, y)), default=(0, None, None), key=lambda g: (g[0], str(g[1]), str(g[2])))
            if best[0] <= 1e-12:
                break
            groups[best[1]] |= groups.pop(best[2])
        of = {v: min(g) for g in groups.values() for v in g}
        return pd.DataFrame({"node": nodes, "betweenness": [between[v] / scale for v in nodes], "community": [of[v] for v in nodes]})

    kind = edges.schema["a"].dataType.simpleString()
    return top_subgraph(edges, n).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda k, f: measure(k, f[["a", "b"]]), f"node {kind}, betweenness double, community {kind}")


def citations(refs: DataFrame, cited_by: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """source, target: papers to what they cite, both ways given, among the allowed papers; papers without an edge do not appear.

    refs: source, target; cited_by: source (cited), target (citing).
    """
    e = refs.select("source", "target").unionByName(cited_by.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source <> target").distinct()
    ok = allowed.select(F.col(key).alias("k")).distinct()
    return e.join(ok.withColumnRenamed("k", "source"), "source", "left_semi").join(ok.withColumnRenamed("k", "target"), "target", "left_semi").select("source", "target")


def newick(df: DataFrame, group: str, leaf: str) -> DataFrame:
    """One row: a tree whose leaves are grouped, all in order. Its size is that of its text."""
    g = df.filter(F.col(group).isNotNull() & F.col(leaf).isNotNull()).groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(F.regexp_replace(leaf, r"\s+", "_"))), ",").alias("l"))
    part = F.concat(F.lit("("), F.col("l"), F.lit(")"), F.regexp_replace(F.col(group), r"\s+", "_"))
    return g.agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list(part)), ","), F.lit(");")).alias("newick"))
