"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import spool


#: A node with more pairs than this, and than its share of HUBS, is a hub.
HUB = 64
#: Hubs at most: their table is broadcast.
HUBS = 1 << 16


def with_least(pairs: DataFrame, value: str) -> DataFrame:
    """``pairs(u, ...)`` with m, the smallest value among u's pairs.

    The minimum is a partial aggregate.  Of n pairs at most HUBS nodes have more than n / HUBS each, so the table
    of these hubs is bounded, and their pairs meet it where they are; the pairs of all others are joined by u.
    """
    least = spool(pairs.groupBy("u").agg(F.min(value).alias("m"), F.count("*").alias("n")), "least")
    limit = max(HUB, -(-(least.agg(F.sum("n")).first()[0] or 0) // HUBS))
    hubs = F.broadcast(least.filter(F.col("n") > limit).select("u", "m"))  # HUBS rows at most
    rest = least.filter(F.col("n") <= limit).select("u", "m")
    return pairs.join(hubs, "u").unionByName(pairs.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def _hook(pairs: DataFrame) -> DataFrame:
    """Each u with its smallest neighbour or itself, joined back onto u's pairs."""
    return with_least(pairs, "v").withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hook(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")
    hooked = _hook(down)
    return hooked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hooked.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    down = edges.groupBy("u").agg(F.count("*").alias("n"))
    if not down.filter("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)`` that is not its own root; root is the component's smallest node.

    Self-links and repeated links do no harm; null ends are dropped; no edges give no rows.
    """
    now = spool(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    while not _are_stars(now):
        now = spool(_small_star(_large_star(now)).filter("u != v").distinct(), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
