"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowstore.plans.tables import cut, drop_cut


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each u, and all its smaller neighbours, on the smallest of them; edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """(id, component) of each node on an edge; component is its smallest node.

    Edges are read as undirected; loops, repeated edges and edges with a null end are
    dropped; no edges give no rows. A round hangs every node's larger neighbours on its
    smallest one (large star), then its smaller ones (small star), until the edges are
    stars, a number of rounds logarithmic in the nodes. A small star comes first, as the
    links of buckets are many for a node but lead to few others. Minima are combined before the
    shuffle, and the join back to the edges may be split at hot nodes by the adaptive
    planner, as the other side has one row a node. Stars
    that nothing else is connected to leave the rounds. Nothing comes to the driver but
    whether any edges are left.
    """
    now = cut(_small_star(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").repartition("u").distinct()))
    closed: list[DataFrame] = []
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        # nodes that hang on two others, or on one while others hang on them: what is connected to none is a finished star
        loose = cut(ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").select("x"))
        if loose.isEmpty():
            break
        hubs = now.join(loose.withColumnRenamed("x", "u"), "u", "left_semi").select("v").unionByName(loose.select(F.col("x").alias("v"))).distinct()
        both = cut(now.join(hubs.withColumn("open", F.lit(True)), "v", "left").select("u", "v", F.coalesce("open", F.lit(False)).alias("open")))
        closed.append(both.where("not open").select("u", "v"))
        active = both.where("open").select("u", "v")
        ways = active.unionByName(active.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = cut(_small_star(large))
        drop_cut(now)
        drop_cut(loose)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    for part in closed:
        now = now.unionByName(part)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
