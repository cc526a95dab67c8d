"""Connected components by alternating large and small stars, each round a shuffle by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise


def _sum(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
    return row.n, row.h


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or else its smaller) neighbours to the smallest of them and itself.

    The smallest is an aggregate with partial minima, and is attached to the
    edges so that a node with very many of them does not meet in one task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
    told = attach(near, materialise(least, "least"), "u", "degree")
    if large:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = told.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return materialise(out.where("u <> v").distinct(), "star")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge table; the root is the smallest node reachable."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (after := _sum(now)) != before:
        before = after
        if not after[0]:
            break
        now = _star(_star(now, True), False)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
