"""Connected components of an edge list, distributed: alternating large-star and small-star.

Each round joins nodes to the smallest neighbour they know; edges never gather on the
driver, and each round is written to the shared folder, where it replaces the one before. Hot nodes
are summed by partial aggregation; when edges meet their node's sum, nodes with more than a
partition's share of the edges (fewer than twice as many as there are partitions) are met by a
broadcast, all others by a shuffle.

Nulls: an edge with a null end is left out. Repeated edges and loops change nothing. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import meet


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return meet(both, least, "u", 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = meet(down, least, "u", count)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) long -> (node, component): the smallest id reachable, for each node with an edge."""
    now = shared.materialise(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct(), "edges")
    count, seen = now.count(), None
    while True:
        large = shared.materialise(_large_star(now, count), "edges")
        after = shared.materialise(_small_star(large, large.count()), "edges")
        shared.discard(now, large)
        now = after
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        count, seen = mark[0], mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
