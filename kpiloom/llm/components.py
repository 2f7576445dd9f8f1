"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.session import cut_lineage


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """node, root for every node of `edges` (a, b: bigint); root is the smallest node it reaches.

    Alternates the two star operations: every node links its larger neighbours to the smallest
    of its neighbourhood, then its smaller neighbours and itself likewise. Each halves long
    chains, so rounds grow with the logarithm of the diameter. Each round is written to the
    checkpoint folder; only a count and a sum come to the driver.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        return both.withColumn("m", least).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        down = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        return down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            down.select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        )

    before = None
    for _ in range(most_rounds):
        edges = cut_lineage(small_star(large_star(edges).distinct()).where("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
