"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), of any type with an order; component is its least node.

    In each round every node points to the least of itself and its neighbours in a random order
    (a hash with a new seed each round), and the edges are moved to the nodes pointed to. Chains
    shrink by a factor in each round, hubs need no more than one row per task thanks to partial
    aggregation, and nothing but a row count comes to the driver.
    """
    pairs = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    n = pairs.count()
    while n:
        seed = F.lit(len(steps) + 1)
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # rank carries the order, node the identity
        rank = lambda c: F.struct(F.xxhash64(c, seed).alias("rank"), F.col(c).alias("node"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least(rank("a"), "least")["node"].alias("to"))
        to = materialise(to, "to")
        steps.append(to)
        ends = {c: to.select(F.col("a").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"}
        moved = pairs.join(ends["a"], "a").join(ends["b"], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        pairs = materialise(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        n = pairs.count()
    if not steps:
        return edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in steps[1:]:
        found = found.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(found.join(least, "root").select("node", "component"), "components")
