"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anomaloom.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    ``edges`` has ``a, b`` (long). Alternates large-star and small-star steps until no edge changes:
    the number of rounds grows with the logarithm of the longest path, every step is a grouped
    minimum and a join, and no group is collected. Each round is written to the shared folder.
    Null ends and loops are ignored; an empty table has no component.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = stage(pairs.distinct(), "edges")
    before = None
    while True:
        mark = _mark(pairs)
        if mark == before or not mark[0]:
            break
        before = mark
        pairs = stage(_small_star(_large_star(pairs)), "edges")
    # Stars now: every edge goes from a node to the smallest node of its component.
    leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    hashed = F.xxhash64("a", "b")
    return tuple(
        pairs.agg(
            F.count(F.lit(1)),
            F.sum(F.shiftright(hashed, 20)),
            F.sum(hashed.bitwiseAND(F.lit((1 << 20) - 1))),
        ).first()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour or itself."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.where(F.col("b") > F.col("a")).join(least, "a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).unionByName(own).distinct()
