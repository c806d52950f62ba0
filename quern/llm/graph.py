"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps until the edges stay the same; each round joins the edges with the least neighbours of their ends, which
    are summed up before they are exchanged, and is written to the checkpoint folder. A node with many edges is a skewed key of such a join, which
    adaptive execution splits; no node's edges meet in one task. Null ends and loops are dropped; no edges give no rows.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = checkpointed(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a").select(F.least("a", "m").alias("a"), "b").where("a <> b")
        small = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        e = checkpointed(small.join(least, "a").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())
