"""Connected components of an edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablemill.session import checkpointed

#: Edges that one task follows by itself; larger graphs go through rounds.
ONE_TASK = 300_000


def few_components(edges: DataFrame) -> DataFrame:
    """As ``connected_components``, but a graph of few edges (a, b) is followed in one task instead of rounds.

    Nodes are whole numbers or arrays of them, without NULL.
    """
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    if edges.count() > ONE_TASK:
        return connected_components(edges)
    kind = edges.schema["a"].dataType.simpleString()
    plain = (lambda v: tuple(map(int, v))) if kind.startswith("array") else int

    def follow(batches):
        above: dict = {}

        def root(n):
            top = n
            while above.setdefault(top, top) != top:
                top = above[top]
            while above[n] != top:
                above[n], n = top, above[n]
            return top

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                low, high = sorted((root(plain(a)), root(plain(b))))
                above[high] = low
        nodes = list(above)
        if nodes:
            yield pd.DataFrame({"node": nodes, "label": [root(n) for n in nodes]})

    return edges.coalesce(1).mapInPandas(follow, f"node {kind}, label {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge; the label is the smallest node of its component.

    Rounds alternate the large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014): the number of rounds grows with the logarithm of the size and no
    neighbour list is ever collected. A hot node is left to the skew handling of adaptive execution.
    """
    x, y = F.col(a), F.col(b)
    graph = checkpointed(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = None
    while True:
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        graph = _star(both, larger_only=True)
        graph = checkpointed(_star(graph, larger_only=False))
        now = graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    labels = graph.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots)


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them.

    ``larger_only`` links only neighbours above the node (large star), else the edges already point
    down and the node itself is linked too (small star).
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = edges.join(least, "u")
    if larger_only:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
