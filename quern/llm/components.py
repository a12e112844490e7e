"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Stored


#: Parts that the edges of one smaller end are dealt to, so that a hub's are in several tasks.
PARTS = 8


def _round(edges: DataFrame) -> DataFrame:
    """A large star, which links the larger end of each edge to the least of the smaller end's neighbourhood, and a small
    star, which links the smaller neighbours of a node, and the node, to the smallest of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # a node without a smaller neighbour, as hubs mostly are, is the least of its neighbourhood itself
    dealt = least.select(F.col("u").alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    large = edges.withColumn("part", F.pmod(F.hash("u"), F.lit(PARTS))).join(dealt, ["v", "part"], "left").select("u", F.coalesce("m", "v").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, store: Stored, label: str) -> DataFrame:
    """node, root: the smallest node of the component of each node that has an edge to another and isn't the root.

    Each round is written to the shared folder, so a lost executor costs one round at most, and the round before
    is deleted. Hubs are reduced by partial aggregates, and the join that fans a hub's minimum out deals its edges over
    PARTS tasks, which adaptive execution splits further. Null ends and loops are dropped. Rounds grow as the log of the
    longest chain.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    edges = store.keep(edges, f"{label}-0")
    mark, n = None, 0
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not seen[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, n = seen, n + 1
        edges = store.keep(_round(edges), f"{label}-{n}")
        store.drop(f"{label}-{n - 1}")
