"""Connected components of a table of links.

Large and small stars alternate until every vertex points to the least one of its component. Each step is a
join over staged tables, so skewed vertices are split by the engine and a lost executor costs a re-read; nothing
is gathered on the driver or in one task. The number of rounds grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> staged (v, root): every vertex of a link with the least
    vertex of its component. An empty table gives an empty result; loops and repeated
    links change nothing."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        # A vertex with two targets, or one that is target and source, is not settled yet.
        places = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).union(edges.select("v").distinct().select("v", F.lit(1).cast("long")))
        if places.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            break
        # Large star: neighbours above u move to u's least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        # Small star: neighbours below u, and u, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = staged(small, "cc")
        drop_staged(edges, large)
        edges = small
    out = staged(edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct()), "cc-roots")
    drop_staged(edges)
    return out
