"""Connected components of an edge table by alternating stars, in joins and minimum aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge in edges (u, v); component is the smallest node reached.

    Kiveris et al., Connected Components in MapReduce and Beyond (2014): each round links larger neighbours
    to the smallest neighbour, then smaller ones; it ends when the edges no longer change. No node's
    neighbours are ever gathered in one place, and each round ends in a table in the shared folder.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())

    # u > v throughout: v is nearer to the component's smallest node.
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        seen = state(now)
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()).distinct()
