"""Connected components of an edge table, by rounds of large-star and small-star.

Edges point from the larger node u to the smaller one v. The least node of a neighbourhood is the smallest v of its node, or the node itself,
so large-star moves an edge (u, v) to (u, least of v) and small-star an edge (u, v) to (v, least of u), or leaves it where v is that
least: one row gives one row, and their number never grows. Trees flatten in a number of rounds that grows with the logarithm of their size.

Minima combine before they are sent, so that a node with very many edges is a small row there; the join with its edges is Spark's own, which
may split them. An edge carries whether its round has moved it: a round that moves none is the last, found without a shuffle. Edges are
written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    seen = edges.withColumn("m", F.min("v").over(W.partitionBy("u")))
    kept = F.col("v") == F.col("m")
    moved = seen.select(F.when(kept, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | ~kept).alias("moved"))
    return moved.groupBy("u", "v").agg(F.max("moved").alias("moved"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) -> (node, component): for each node that has an edge, the smallest node it can reach.

    Loops and null ends are ignored, repeated edges count once; no edges give no rows."""
    edges = materialised(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        edges = materialised(_small_star(_large_star(edges)))
        if edges.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # every node but the roots has one edge now, to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
