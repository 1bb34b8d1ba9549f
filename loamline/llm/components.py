"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps (Kiveris et al., Connected Components in
MapReduce and Beyond): each is an aggregation and a join, each round is written to the
shared folder, and nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(stash: Stash, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``node, root`` for every node of an edge; root is the least node of its component.

    ``edges`` has two long columns, in any direction, repeated or not; loops are ignored.
    """
    a, b = edges.columns
    now = stash.save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}0")
    seen, turn = None, 0
    while True:
        both = now.union(now.select("v", "u"))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met = large.join(_least(large), "u")
        small = met.select("u", F.col("m").alias("v")).union(met.where("v <> m").select("v", "m")).distinct()
        turn += 1
        after = stash.save(small, f"{name}{turn}")
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        stash.drop(f"{name}{turn - 1}")
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
