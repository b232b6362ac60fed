"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored


def _stars(links: DataFrame) -> bool:
    """Whether every link (u, v) leads to the end: no u has two, and no v has a link of its own."""
    more = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return more.isEmpty() and links.join(links.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has a link.

    Each round links every node to the smallest of its neighbours, by partial
    aggregation and joins whose large side AQE can split, so that a hub's links
    need not meet in one task; rounds grow as the logarithm of the longest path.
    Each is written to the shared folder. Nulls and loops are no links.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    links = stored(links.distinct())
    for _ in range(most_rounds):
        if _stars(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        before, links = links, stored(small.select("x.u", F.col("x.m").alias("v")).where("u != v").distinct())
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
