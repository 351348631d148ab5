"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.plans.shared import join_groups, written


#: Up to so many edges no hub is too large for a plain join, and a round is one job.
FEW = 200_000


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m of their u; hubs are joined apart, unless all edges are few."""
    if n <= 2 * FEW:
        return edges.join(least.drop("k"), "u")
    return join_groups(edges, written(least, "least"), ["u"], "k", n)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
    return _with_least(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = low.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    joined = _with_least(low, least, n)
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        .union(joined.select("u", F.col("m").alias("v"))).distinct()
    )


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    Edges with a null end and loops of a node onto itself are dropped (a node
    that has only these is absent); repeated edges count once. No edges give an
    empty result. A round ends with a written table, so the plan stays small and
    a lost executor costs one round. The number of rounds grows with the
    logarithm of the longest path. A node's edges are never gathered in a list,
    and hubs are joined by a broadcast of bounded size.
    """
    now = written(
        edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    n, mark = now.count(), None
    for _ in range(max_rounds if n else 0):
        # neither star makes more edges than it is given, so n bounds what the hubs of both are measured by
        large = _large_star(now, n)
        now = written(_small_star(large if n <= FEW else written(large, "large_star"), n), "round")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        n, mark = new[0], new
    else:
        if n:
            raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
