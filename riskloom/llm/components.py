"""Connected components of an edge table, by alternating stars.

Each step is a grouped minimum and a join, its result is written to the shared
folder, and the number of steps grows with the logarithm of the longest path.
No adjacency list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.durable import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "star")
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    low = materialise(down.groupBy("a").agg(F.min("b").alias("low")), "star")
    moved = down.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge but the smallest ones themselves.

    Nodes are longs. Loops, repeated edges and either direction are fine; rows
    with a null end are no edge. An empty table gives an empty one.
    """
    now = materialise(
        edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct(),
        "edges",
    )
    while True:
        after = materialise(_small_star(_large_star(now)).where("a > b").distinct(), "edges")
        moved = after.join(now, ["a", "b"], "left_anti").limit(1).count() + now.join(after, ["a", "b"], "left_anti").limit(1).count()
        now = after
        if not moved:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
