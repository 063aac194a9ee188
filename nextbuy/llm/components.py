"""Connected components by alternating star contraction, entirely in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) rows: link the larger (or smaller) neighbours of u to u's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = both if large else both.filter("v < u")
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = rows.join(least, "u")
    linked = near.filter("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    linked = linked.filter("u <> v")
    return linked if large else linked.distinct()  # repeated edges do no harm in between


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the least node reachable. Only nodes of (a, b) edges occur.

    Stars are contracted until every node but a star's centre has exactly one
    edge, to the centre (a logarithmic number of rounds); each round is written
    to the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        placed = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
        # not yet a star: a child of two centres, or a centre that is a child
        if placed.groupBy("x").agg(F.sum("child").alias("child"), F.max("centre").alias("centre")).filter("child + centre > 1").isEmpty():
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                roots.select("node", F.col("node").alias("comp")))
        now = stored(_star(_star(now, large=True), large=False), "edges")
    raise ValueError(f"components did not settle within {max_rounds} rounds")
