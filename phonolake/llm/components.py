"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.session import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable. Nodes without an edge are not in the result.

    Each round hangs every neighbour on the smallest one known; what is left is one star per component. A round is a
    grouped minimum and a join, so a node with very many neighbours is pre-aggregated and its rows can be split.
    """
    links = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.expr("CAST(xxhash64(u, v) AS DECIMAL(38,0))"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
