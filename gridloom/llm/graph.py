"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_empty


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u points at the least of u's circle; else every smaller one and u itself do."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, most: int = 40, name: str = "edges") -> DataFrame:
    """``edges(u, v)`` of integers -> ``(node, component)`` for nodes with an edge; component: the least node reachable.

    Null ends and loops are left out; no edges give no rows. Each round is written to the shared folder. A hot node's
    edges meet only in a partial minimum and a join that may be split, never in one task.
    """
    spark = edges.sparkSession
    now = scratch.save(edges.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), f"{name}-0")
    before, step = None, 0
    while not is_empty(now):
        step += 1
        nxt = scratch.save(_star(_star(now, True), False), f"{name}-{step}")
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{step - 1}")
        now = nxt
        if mark == before:
            break
        if step >= most:
            raise RuntimeError("components did not settle")
        before = mark
    both = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return both.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct() if step else spark.createDataFrame([], "node long, component long")
