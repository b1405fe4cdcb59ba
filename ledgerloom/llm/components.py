"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is a min per node (combined before the shuffle) and a join that AQE may split where a node has very many
edges; edges stay in the shared folder between rounds. Nothing is gathered on the driver but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: a node's larger neighbours move to its least one. Small: its smaller ones do."""
    side = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        side = side.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = side.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = side.where("v > u") if large else side
    out = moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches, for all nodes but the least themselves."""
    cur = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(cur)
    while before[0]:
        cur = stored(_star(stored(_star(cur, True), "large"), False), "small")
        after = mark(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
