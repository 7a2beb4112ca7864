"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches):
    """Each partition's edges as a star forest: (node, smallest node of its local component)."""
    import pandas as pd

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 2_000_000:  # bounded memory: hand on what is known and start anew
            yield pd.DataFrame([(n, find(n)) for n in parent], columns=["a", "b"])
            parent.clear()
    nodes = [(n, r) for n in list(parent) if (r := find(n)) != n]
    yield pd.DataFrame(nodes, columns=["a", "b"], dtype="int64")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: greater neighbours are hung on the smallest; else smaller ones and the node itself are."""
    if large:
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = sides.join(low, "a")
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node reachable.

    Edges are long pairs in any order, loops and repeats allowed, nulls ignored; without edges the result is empty.
    Every round is checkpointed; hot nodes meet only in aggregates and in joins that adaptive execution can split.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").mapInPandas(_forest, "a long, b long")
    edges, seen = cut(edges.distinct()), None
    for _ in range(max_rounds):
        n, h = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, h) == seen or not n:
            break
        seen = (n, h)
        edges = cut(_star(_star(edges, large=True), large=False))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
