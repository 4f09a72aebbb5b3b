"""Connected components over an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from opsrecall.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the least node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    every step only puts the minimum of a node's neighbours beside each of them, so a
    node with very many neighbours is never gathered into one row. Rounds grow with the
    logarithm of the longest path. Each round ends at a checkpoint, and the only
    thing the driver reads is whether the edges form stars yet. A round shuffles three
    times and its test once, without joins, so that the driver plans few stages.
    """
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    )
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v").distinct()
    least = F.min("v").over(Window.partitionBy("u"))
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.withColumn("m", F.least("u", least)).where("v > u AND v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        linked = large.withColumn("m", least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = cut(linked.where("u <> v").distinct())
        # Of every node how many parents it has, and whether it is one.
        ends = e.select(F.inline(F.array(
            F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        told = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if told.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
    alone = nodes.select("node", F.col("node").alias("root"))
    return alone.union(e).groupBy("node").agg(F.min("root").alias("root"))
