"""Connected components of a graph whose largest component may hold a third of it.

Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). Each step
points the neighbours of a node at their smallest one: an aggregate that combines
before its shuffle, and an equi-join of two written tables, whose hot keys adaptive
execution can split. Every step is written to the shared folder, so the lineage
stays short and no executor's loss undoes it. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_STEPS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the smallest reachable.

    Self-links and repeated or reversed links count once; rows with a null end are
    left out. An empty table gives an empty one.
    """
    links = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_STEPS):
        links = staged(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "lowest")
    pointed = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return staged(pointed.distinct(), "links")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours at the smallest of them."""
    lowest = staged(links.groupBy("u").agg(F.min("v").alias("low")), "lowest")
    pointed = links.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return pointed.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()
