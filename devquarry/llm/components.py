"""Connected components of an undirected edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete


def connected_components(edges: DataFrame, folder: str, name: str, most_rounds: int = 60) -> DataFrame:
    """node and component, the smallest node reachable, of every node of the edges (u, v).

    Alternates the large star (each node's larger neighbours go to its smallest) and the small star (its
    smaller neighbours do), which end in stars around the components' smallest nodes after O(log n) rounds
    in practice. Each round is a table below ``folder``, so a lost executor repeats one round at most.
    A node with very many neighbours is a skewed key of plain joins, which Spark splits.
    """
    spark = edges.sparkSession
    at = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), folder, f"{name}-0")
    before = None
    for i in range(1, most_rounds + 1):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, folder, f"{name}-{i}")
        delete(spark, f"{folder}/{name}-{i - 1}")
        # a star forest has one edge for each node that is no centre, and no centre with an edge upwards
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        at = new
        if state == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components not found in {most_rounds} rounds")
