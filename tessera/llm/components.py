"""Connected components of an edge table by repeated contraction.

Each round every vertex points at its smallest neighbour or itself, pointers
are doubled once, and edges are rewritten to the vertices pointed at.  Only
local minima stay, so the vertices at least halve and log2(n) rounds suffice.
All steps are equi-joins against a table with one row per vertex, or minima
that combine before the shuffle, so a star of any size is split between tasks
by adaptive skew joins.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of an edge: the smallest in reach."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = materialise(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        point = materialise(point, "point")
        jump = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
        point = materialise(point.join(jump, "to").select("node", F.col("next").alias("to")), "jump")
        if labels is None:
            labels = point.select("node", F.col("to").alias("component"))
        else:
            step = point.select(F.col("node").alias("component"), "to")
            labels = materialise(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        pa, pb = (point.select(F.col("node").alias(x), F.col("to").alias(f"p{x}")) for x in "ab")
        e = e.join(pa, "a").join(pb, "b").filter("pa <> pb")
        e = materialise(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def forest(n: int, left, right) -> list[tuple[int, int]]:
    """Spanning edges (root, vertex) of the graph on 0..n-1 with these edges.

    Roots are the smallest vertex of each tree, so a group of any density
    leaves fewer edges than it has vertices.
    """
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(left, right, strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(r, x) for x in range(n) if (r := find(x)) != x]
