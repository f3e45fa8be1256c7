"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.text import stored


def _to_least(edges: DataFrame, upward: bool) -> DataFrame:
    """Hang neighbours of every node on the least node next to it: the larger
    neighbours (`upward`) or the smaller ones and the node itself."""
    if upward:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        moved = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (least node reachable) for every linked node.

    `links` has columns `a` and `b`; direction, loops and repeats don't matter.
    Large-star and small-star steps alternate until nothing changes: the number
    of links never grows, and rounds grow with the logarithm of a component.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(ordered.where("a <> b").distinct(), "links")
    state = None
    while True:
        edges = stored(_to_least(_to_least(edges, upward=True), upward=False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", F.col("b").alias("component")))
