"""Connected components by alternating large-star and small-star steps; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). Large: each node's greater neighbours get its least neighbour. Small: its lesser ones do."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Written, as Spark then splits the neighbours of a hub.
    least = common.materialise(least, "least")
    joined = both.join(common.small(least), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for all nodes of edges (u, v) but the roots; u <> v in any order."""
    now = common.materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = common.materialise(_star(_star(now, True), False), "links")
