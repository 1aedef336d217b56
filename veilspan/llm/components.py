"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import Stored


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """Smallest node reachable from every node that has an edge.

    ``edges`` has columns a and b (long). Rounds of large-star and small-star
    joins turn the graph into stars whose centre is the smallest node. Every
    round is stored in the shared folder, and the one before it deleted. Loops
    and repeated edges do no harm; no edge gives no row. Returns node, root.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = store.put(edges.filter(F.col("a") != F.col("b"))
                    .select(high.alias("u"), low.alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = store.put(_small_star(_large_star(now)))
        store.drop(now)
        now, (mark, before) = after, (_mark(after), mark)
        if mark == before:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"),
                                         F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: equal marks, equal graphs."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                           F.bit_xor(F.xxhash64("v", "u"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of a node to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (edges.join(least, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
