"""Connected components by alternating large-star / small-star steps.

Each step is one grouped minimum and one join; nothing is collected.  The minima are written to
the shared checkpoint folder before they are joined, so that both sides of the join are exchanges
of its own and adaptive execution can split the node of a very large star.  The rounds (about
log n) stop when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_table

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them (edges hold u > v)."""
    least = keep_table(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node points to one centre, and centres point nowhere."""
    twice = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.unionByName(chained).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links(a long, b long)``; component = smallest reachable id.

    Self links and repeated links are allowed, null ends are ignored.  Ids without a link to
    another id are not returned.
    """
    edges = (links.where("a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = keep_table(edges, "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        edges = keep_table(_small_star(keep_table(_large_star(edges), "edges")), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(roots.select("id", F.col("id").alias("component"))))
