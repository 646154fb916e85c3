"""Connected components of a graph given as a table of links, by alternating large and small stars.

In a large star every node links its larger neighbours to the smallest node it knows, in a small star its
smaller neighbours and itself. After a few rounds, in the order of the square of the logarithm of the nodes,
each component is a star around its smallest node. Only DataFrame operations are used; a round is cut by a
checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenlight.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest node, for every node of ``links`` (columns a and b of one type that can be
    ordered). Links from a node to itself and repeated links don't matter; null ends are left out."""
    links = cut_lineage(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    before = _state(links)
    while before[0]:
        links = cut_lineage(_small_star(_large_star(links).where("a <> b").distinct()).where("a <> b").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
