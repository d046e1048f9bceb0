"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    moved = edges.join(least, edges["hi"] == least["u"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with an edge to another, the smallest node that its edges reach.

    edges holds two long columns; loops, repeated and null edges are passed over. Rounds of joins and aggregations, each
    checkpointed, until every node points at its component's smallest: about the logarithm of the longest path. A hub's
    rows meet in a join, which adaptive execution splits, and in a min(), which is combined before the shuffle.
    """
    now = checkpointed(
        edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or state[0] == 0:
            break
        mark = tuple(state)
        now = checkpointed(_small_star(_large_star(now)))
    roots = now.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
