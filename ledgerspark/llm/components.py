"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round takes the smallest neighbour of every vertex (a partial minimum before the shuffle) and joins it back to
the edges, so a vertex with very many edges is split by adaptive execution.  Rounds are written to the shared
folder; nothing but their counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark.llm.base import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    ends = edges.union(edges.select("b", "a")) if large else edges
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ends.join(materialize(least, "components-least"), "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(joined.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of ``edges (a, b)`` but the smallest of each component, which stands for it.

    Loops, repeated edges and nulls are allowed; null ends are left out.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    now = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while not _finished(now):
        now = materialize(_star(materialize(_star(now, True), "components-large"), False), "components")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _finished(edges: DataFrame) -> bool:
    """Whether every vertex points at one other that points nowhere."""
    targets = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if not targets.where("n > 1").isEmpty():
        return False
    return edges.select(F.col("b").alias("a")).distinct().join(targets, "a", "left_semi").isEmpty()
