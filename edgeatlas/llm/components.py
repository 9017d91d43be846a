"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregation (combined on the map side, so a hub node costs one row a task) and a join on the node,
which adaptive execution may split. Nothing is collected but one checksum row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Edges with a null end and self-loops are ignored; repeated edges count once; no edges give an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.where("u > v").distinct(), "stars")
        drop(edges.sparkSession, last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not converge")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(a, b):
    """Union-find over local links (integer arrays): pairs (node, smallest node of its tree), roots left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        p, q = find(int(x)), find(int(y))
        if p != q:
            parent[max(p, q)] = min(p, q)
    return [(x, r) for x in parent if (r := find(x)) != x]
