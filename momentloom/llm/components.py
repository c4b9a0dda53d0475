"""Connected components by alternating star contractions, all on DataFrames.

Every round replaces each node's neighbours by the smallest one it knows. Minima combine on the
map side, so a hub with a third of all links is no hot task; the joins are ones that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.shared import fingerprint, stable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node that has a link to another one; ``root`` is the smallest node
    that can be reached. Self links, repeated links and links with a null end are ignored."""
    edges = stable(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(f"`{a}` is not null and `{b}` is not null and u != v").distinct()
    )
    seen = fingerprint(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above a node move to the node's minimum.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stable(large)
        # Small star: neighbours below a node move to their minimum, and so does the node.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stable(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = fingerprint(edges)
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
        seen = now
