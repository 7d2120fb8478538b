"""Connected components of links by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A node with more than this part of all links, and more than LEAST_HUB, is a hub. There are fewer than 2 * HUB_PART of them, as a
#: link has two ends, so their rows are broadcast and their links stay where they are.
HUB_PART, LEAST_HUB = 10_000, 500


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _with_least(edges: DataFrame, of: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with m, the least v that u has in `of`. A node's least is found by partial minima; the links of nodes with more
    than `hub` of them meet it by broadcast, the others by a shuffle, in which no key has more than `hub` rows."""
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(least.filter(F.col("degree") > hub).select("u", "m"))
    rest = least.filter(F.col("degree") <= hub).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def _large(edges: DataFrame, hub: int) -> DataFrame:
    """Links every larger neighbour of a node to the least node in sight."""
    near = _both(edges)
    return _with_least(near.filter("v > u"), near, hub).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, hub: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these. Edges come with u > v."""
    return _with_least(edges, edges, hub).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) -> node, label: the least node of its component. Nodes without a link to another node have no row. The result
    reads tables of scratch."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = scratch.write(edges, "edges"), None
    now = _sum(edges)
    while now != before and now[0]:
        hub = max(LEAST_HUB, now[0] // HUB_PART)
        far = scratch.write(_large(edges, hub).distinct(), "large")
        edges = scratch.write(_small(far, hub).distinct(), "small")
        before, now = now, _sum(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
