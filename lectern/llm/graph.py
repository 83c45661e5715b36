"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b), which are bigint; component: the least node reachable.

    Each round every node points to its least neighbour if that is less than itself,
    pointers are followed until they end, and the edges are drawn anew between
    what the pointers lead to. The least node of a component is never lost, and every other
    component of a round's graph at least halves, so the rounds are few. All is
    done by joins and sums by key; nothing is gathered.
    """
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers")
        while True:
            after = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            old, point = point, keep(point.drop("moved").join(after, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            discard(old)
            if point.where("moved").isEmpty():
                break
        if labels is None:
            labels = keep(point.select("node", F.col("to").alias("component")), "labels")
        else:
            onward = point.select(F.col("node").alias("component"), F.col("to").alias("next"))
            old, labels = labels, keep(labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
            discard(old)
        ends = point.select(F.col("node").alias("a"), F.col("to").alias("c"))
        left = edges.join(ends, "a").select(F.col("c").alias("x"), "b")
        left = left.join(ends.select(F.col("a").alias("b"), F.col("c").alias("y")), "b").where("x != y")
        old, edges = edges, keep(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old, point)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
