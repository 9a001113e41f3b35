"""Connected components of links between integers, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (else the smaller) neighbours of every node to the least of its neighbourhood."""
    near = _both(edges)
    if not large:
        near = near.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    held = near.where("v > u") if large else near
    moved = held.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b): a row (node, root) for every node that has a link; root is the least node it can reach.

    Self links and repeated links count for nothing, and links with a null are left out. Every round is checkpointed; nothing is collected
    but one row that tells whether links have changed.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
