"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Least neighbours are combined where the edges are and joined with the edges, so the edges of one hub may be spread over tasks."""
    both = edges.select(F.col("u").alias("c"), F.col("v").alias("n")).union(edges.select(F.col("v").alias("c"), F.col("u").alias("n")))
    if not large:
        both = both.filter("n < c")
    least = both.groupBy("c").agg(F.min("n").alias("m")).withColumn("m", F.least("c", "m"))
    if large:
        out = both.filter("n > c").join(least, "c").select(F.col("n").alias("u"), F.col("m").alias("v"))
    else:
        out = both.join(least, "c").select(F.col("n").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) other than the roots; root is the least id of its component.

    Each round is written to the shared folder, so lineage stays short. The rounds end when the edges
    form stars, after O(log n) rounds in practice. Null and self edges count for nothing.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = None
    while True:
        before, now = now, cut(_star(_star(now, True), False), "cc")
        discard(before)
        seen = now.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
