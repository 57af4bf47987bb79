"""Connected components of an edge table by alternating star contraction.

Large star hands every larger neighbour of a node the smallest node it sees; small star
does so with the smaller neighbours. Edges end up as stars around each component's smallest
node after a number of rounds that grows with the logarithm of the longest path. Nodes with
many edges are joined, never gathered: each round is two aggregations to a minimum and two
joins that Spark can split where a key is hot. Every round is written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.materialize import discard, materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and the smallest node reachable from it, for nodes other than that smallest.

    Loops and repeated edges do no harm; nulls on either side are left out.
    """
    now = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )
    before = _mark(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = materialize(
            both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, now = now, materialize(moved.union(least.select("hi", "m")).distinct())
        discard(old, large)
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
