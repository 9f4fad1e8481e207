"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Rows (a, b) with b < a, as many as edges."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    near = edges.select(F.explode(ways).alias("e")).select("e.a", "e.b")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """down: rows (a, b) with b < a."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of long ids. Returns (a, b): for each node a that reaches a smaller id, the smallest that it reaches.

    A node without a row is the smallest of its component, or has no edge. No edges give no rows; loops and repeated edges
    change nothing. What was returned before, with further edges, gives what all edges give.
    """
    edges = cut(edges.where("a <> b").select("a", "b"))
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(edges)
    while seen[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges
