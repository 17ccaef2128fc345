"""Connected components of an edge list, by alternating large-star and small-star steps.

Each step joins the edges with the smallest neighbour of each node, so a hub is split by Spark like any hot join key, and
every round is landed in the shared folder: lineage stays short and a lost executor costs nothing. The number of rounds
grows with the logarithm of the longest path. Nothing but a count and a checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk.llm.frames import land


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; edges: columns `a`, `b`, long."""
    now = land(_downward(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo"))), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select("lo", "hi"))
        least = land(both.groupBy("hi").agg(F.min("lo").alias("least")).select("hi", F.least("hi", "least").alias("least")), "least")
        large = _downward(both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")))
        large = land(large, "large-star")
        least = land(large.groupBy("hi").agg(F.min("lo").alias("least")), "least")
        small = large.join(least, "hi").select("hi", "lo", "least")
        new = land(_downward(small.select(F.inline(F.array(F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))))), "small-star")
        before, state = state, _state(new)
        now = new
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
