"""Connected components of a graph by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import durable


def _star(edges: DataFrame, keep: Column) -> DataFrame:
    """Links the neighbours of each node (those that ``keep`` names) to the smallest of them and itself.

    A hot node's neighbours are never listed: the smallest is an aggregate, joined back.
    """
    least = edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("least", "node").alias("least"))
    joined = edges.join(least, "node")
    return joined.where(keep).select(F.col("other").alias("node"), F.col("least").alias("other")).where("node != other").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """From rows (a, b) the rows (node, component) of all nodes with links; component is the smallest node.

    Large stars and small stars in turn (Kiveris et al., 2014), until nothing changes: then every node is linked
    to its component alone. A few rounds suffice for stars, about the square of the logarithm at worst.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    state = durable(both)
    said = None
    for _ in range(rounds):
        ways = state.union(state.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(ways, F.col("other") > F.col("node"))
        # small star: from each node to its smaller neighbours; the node itself joins the smallest, too
        down = large.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
        least = down.groupBy("node").agg(F.min("other").alias("least"))
        small = down.join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        own = least.select("node", F.col("least").alias("other"))
        state = durable(small.union(own).where("node != other").distinct())
        sums = state.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other")), F.sum(F.xxhash64("node", "other") % 1_000_003)).first()
        if tuple(sums) == said:
            break
        said = tuple(sums)
    return state.select("node", F.col("other").alias("component"))
