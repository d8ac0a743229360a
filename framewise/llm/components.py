"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import stored


def components(links: DataFrame, name: str = "star") -> DataFrame:
    """``node, label`` of every node in links ``u, v``; the label is the component's smallest node.

    A large-star step hangs the larger neighbours of a node on the smallest neighbour, a small-star
    step the smaller ones; both keep the components and end in one star each.  Every step is a
    grouped minimum and a join with the stored minima, so a node with many neighbours is never
    gathered and Spark can split it in the join.  Each round is written to the shared folder.
    """
    edges = stored(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v")).distinct(),
        name,
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        # larger neighbours of u are hung on m
        large = (
            edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = stored(large.distinct(), name)
        # smaller neighbours of u, and u, are hung on the smallest
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        edges = stored(small.where(F.col("u") != F.col("v")).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select("v", "v").distinct().toDF("node", "label")
    )
