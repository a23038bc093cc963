"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the smallest node that can be reached.

    Each round hangs every neighbourhood under its smallest node; the rounds grow with the logarithm of the longest
    chain. All of it is joins and minima over edges, so no component is gathered anywhere. Self-loops and repeated or
    null edges are harmless; a node without edges isn't listed.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        mark = seen
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        hung = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = written(hung.union(least).distinct(), "edges")
