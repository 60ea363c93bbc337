"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one grouped minimum and one equi-join, so a hub with very many neighbours is
pre-aggregated before its shuffle and its join is left to skew handling of adaptive execution.
The edges after each round are a table in the shared folder; only their count and a checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrspark.llm.common import discard, materialize


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    lowest = _min_neighbour(down)
    joined = down.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(lowest.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Label of each node that has an edge: columns ``node``, ``component`` (smallest node id).

    Null ends and loops give no row; repeated edges count once. An empty table gives an empty table.
    """
    now = materialize(
        edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        large = materialize(_large_star(now).distinct(), "large")
        after = materialize(_small_star(large).distinct(), "small")
        seen = after.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
        ).first()
        discard(now)
        discard(large)
        now = after
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
