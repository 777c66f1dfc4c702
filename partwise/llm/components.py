"""Connected components of an edge table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the smallest id reachable.

    Alternates large-star and small-star steps (each a ``min`` per node, joined back), which halve the distance to
    the smallest id, so the number of rounds grows with the logarithm of the longest path.  No neighbourhood is ever
    gathered: a node with a third of all edges only meets a partial ``min`` and a join that AQE may split.
    Self loops and repeated edges are allowed; null ends are ignored.  Each round is a table in the shared folder.
    """
    pairs = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    loops = pairs.where("a = b").select("a").distinct()
    pairs = materialise(pairs.where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "a", "m")
        pairs = materialise(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    centres = pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(centres).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
