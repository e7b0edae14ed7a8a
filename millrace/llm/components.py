"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.joins import attach_by_key
from millrace.plans.staging import stage


def _staged(df: DataFrame, name: str) -> DataFrame:
    return stage(df, f"components-{name}")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component`` for every node with a link; ``component`` is the smallest node reachable.

    Each round replaces the links of a node by links to its smallest neighbour, first for larger
    neighbours and then for smaller ones, and ends when nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Every round is written to the shared folder, so a lost
    executor costs no earlier round. A node with very many links is split by ``attach_by_key``.
    Null ends, links of a node to itself and repeated links do no harm; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = _staged(
        links.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "large")
        larger = attach_by_key(both.filter("v > u"), nearest, "u", "n", "m", F.col("v"))
        edges = _staged(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")

        nearest = _staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        linked = attach_by_key(edges, nearest, "u", "n", "m", F.col("v")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _staged(linked.union(nearest.select("u", F.col("m").alias("v"))).distinct(), "links")

        # Links only ever move to smaller nodes, so equal sums mean that none moved.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
