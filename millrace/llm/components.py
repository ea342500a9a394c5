"""Connected components of a link table, by stars that grow and join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.store import Scratch


def _large_stars(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b)`` links to ``(node, component)``: the smallest node that is reachable. Only linked nodes appear.

    Each round hangs neighbours below the smallest one they know; no node's neighbours are gathered
    in one place, sums of the edges tell when nothing moves any more. NULL ends and self-links are ignored.
    """
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    sign = None
    while True:
        new = scratch.write(_small_stars(_large_stars(edges)), "stars")
        scratch.drop(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = now
