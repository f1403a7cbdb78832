"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shuffled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Every message is a pair of ids; a hub's messages are dealt by plain joins that AQE can split."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.join(shuffled(least), "a")
    if large:
        out = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (two long columns); component: its smallest node.

    Rounds repeat until the edge set stands still; only its size and a checksum reach the driver.
    Self-loops and null ends link nothing. Fails rather than return an unfinished labelling.
    """
    a, b = edges.columns[:2]
    now = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    )
    mark = None
    for _ in range(rounds):
        n = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == mark or not n[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b"), F.col("b")).distinct()
            )
        mark, before = n, now
        now = materialize(_star(_star(now, large=True), large=False))
        discard(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
