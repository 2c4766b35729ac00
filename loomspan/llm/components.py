"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and combinable minima over (u, v) longs; nothing is
collected, and each round ends in a written table. Hubs are hot keys only on
the many-row side of an inner join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.unionByName(flipped) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    centre = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(centre, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centre.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v longs): root is the smallest node it reaches. Loops and repeats are fine."""
    edges = materialize(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        after = materialize(_stars(_stars(edges, True), False), "edges")
        discard(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
