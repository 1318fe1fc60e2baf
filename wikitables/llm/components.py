"""Connected components of a links table by alternating large and small stars.

Every round is two minimum aggregations (combined before the shuffle) and two
equi-joins, and is stored, so lost executors cost one round.  The number of
rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns u, v; returns (u, root) for each node but the roots: the least node reachable."""
    edges = stored(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        # Large star: larger neighbours move to the least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(),
            "large-star",
        )
        # Small star: smaller neighbours and the node itself move to the least of them.
        small = large.join(_least(large), "u")
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "small-star",
        )
    return edges.select("u", F.col("v").alias("root"))
