"""Connected components by alternating star operations on stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (a, b): component is the smallest node it is linked to.

    The number of rounds grows with the logarithm of the longest path. Each
    round is written to the shared folder, so a lost executor repeats one round
    at most. Loops (a = b) and repeated edges do no harm; null ends are left
    out; no edges: no rows.
    """
    current = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        current = stored(_small_star(_large_star(current)), "stars")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
