"""Trees over vectors, built level by level in Spark: splits, leaves, and routing by lower bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.vectors import deviation, doubles, mean, part
from nearlake.operators.knn import knn
from nearlake.operators.partition import with_places
from nearlake.operators.tables import settled

MAX_DEPTH = 16

#: Visits of leaves that are broadcast at once.
VISITS = 16_384


def split_once(rows: DataFrame, widest: int = 1) -> DataFrame:
    """One more level: each node's rows are parted at the mean of its dimension with the largest variance.

    ``widest`` > 1 takes one of that many dimensions, by a hash of the node. The table of splits has
    a row per node, so at most 2**depth. Means are rounded, as sums depend on row order.
    """
    parts = rows.select("node", F.posexplode(doubles(F.col("v"))).alias("i", "x"))
    spread = parts.groupBy("node", "i").agg(F.round(F.var_pop("x"), 9).alias("var"), F.round(F.avg("x"), 9).alias("mean"))
    placed = spread.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("var"), "i")) - 1)
    chosen = placed.where(F.col("r") == F.pmod(F.xxhash64("node"), F.lit(widest))).select("node", F.col("i").alias("dim"), "mean")
    side = F.when(doubles(F.col("v"))[F.col("dim")] < F.col("mean"), 0).otherwise(1)
    return rows.join(F.broadcast(chosen), "node").withColumn("node", 2 * F.col("node") + side).drop("dim", "mean")


def kd_tree(rows: DataFrame, depth: int, widest: int = 1) -> DataFrame:
    """Adds node, the leaf of each row: 1 is the root, 2 n and 2 n + 1 are the children of n."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}")
    out = rows.withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        # a level reads the rows twice, so without a table between levels the plan would double with each
        out = split_once(out if level == 0 else settled(out), widest)
    return out


def boxes(leaves: DataFrame) -> DataFrame:
    """(node, low, high, n): the range of each component in each leaf."""
    parts = leaves.select("node", F.posexplode(doubles(F.col("v"))).alias("i", "x")).groupBy("node", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "lo", "hi")))
    return parts.groupBy("node").agg(ordered.alias("b"), F.max("n").alias("n")).select("node", F.transform("b", lambda s: s["lo"]).alias("low"), F.transform("b", lambda s: s["hi"]).alias("high"), "n")


def lower_bound(q: Column, low: Column, high: Column) -> Column:
    """Least squared distance from q to anything in a box."""
    beyond = F.zip_with(F.zip_with(doubles(q), low, lambda x, a: a - x), F.zip_with(doubles(q), high, lambda x, b: x - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(beyond, F.lit(0.0), lambda s, x: s + x * x)


def route(queries: DataFrame, leaf_boxes: DataFrame, n: int) -> DataFrame:
    """(qid, rank, node, bound): the n leaves of each query with the least bounds."""
    scored = queries.crossJoin(F.broadcast(leaf_boxes)).select("qid", "node", lower_bound(F.col("q"), F.col("low"), F.col("high")).alias("bound"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("bound", "node")))
    return ranked.where(F.col("rank") <= n).select("qid", "rank", "node", "bound")


def search_leaves(leaves: DataFrame, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, d): of the rows (id, v, node) in the leaves that each query visits (qid, node) the k nearest, exactly.

    Rows meet the queries that visit their leaf within the task, by matrix products, so no pair leaves it but k a query and leaf.
    """
    asked = visits.select("qid", F.col("node").alias("leaf")).join(queries.select("qid", "q"), "qid")
    return knn(leaves.select("id", "v", "node"), asked, k, block=VISITS, same=("node", "leaf"))


def select_heads(rows: DataFrame, depth: int) -> DataFrame:
    """(cid, c): of each leaf the row nearest to the leaf's mean."""
    from nearlake.operators.graph import medoid

    leaves = kd_tree(rows.select("id", "v"), depth)
    chosen = medoid(leaves, "node").select("id")
    return rows.join(chosen, "id", "left_semi").select(F.col("id").alias("cid"), F.col("v").alias("c"))


#: A node of at most so many rows is split to its end in one task.
GROUP_ROWS = 20_000

#: Nodes are numbered as in ``kd_tree``, so none is deeper than this.
DEEPEST = 60


def split_down(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, node): the node of each row (id, v) once all nodes are split until their rows are single or equal.

    Splits are those of ``split_once``: by levels in Spark for nodes of more than ``group_rows`` rows, within a task for
    others. A larger node whose rows are equal stays as it is.
    """
    open_, done = rows.select("id", "v").withColumn("node", F.lit(1).cast("long")), []
    for _ in range(DEEPEST - 20):
        open_ = settled(open_)
        sizes = open_.groupBy("node").agg(F.count("*").alias("n"), (F.min("v") == F.max("v")).alias("equal"))
        large = settled(sizes.where((F.col("n") > group_rows) & ~F.col("equal")).select("node"))
        equal = settled(sizes.where((F.col("n") > group_rows) & F.col("equal")).select("node"))
        done.append(open_.join(equal, "node", "left_semi").select("id", "node"))
        small = open_.join(large, "node", "left_anti").join(equal, "node", "left_anti")
        done.append(small.groupBy("node").applyInPandas(_to_the_end, "id long, node long"))
        if large.isEmpty():
            break
        open_ = split_once(open_.join(large, "node", "left_semi").select("id", "v", "node"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _to_the_end(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("id")
    ids, v = group["id"].to_numpy(), np.array(group["v"].tolist(), float)
    node = np.empty(len(ids), np.int64)
    todo = [(np.arange(len(ids)), int(group["node"].iloc[0]))]
    while todo:
        own, name = todo.pop()
        spread = np.round(v[own].var(axis=0), 9)
        dim = int(spread.argmax())
        left = v[own, dim] < round(v[own, dim].mean(), 9)
        if name >> DEEPEST or left.all() or not left.any():
            node[own] = name
        else:
            todo += [(own[left], 2 * name), (own[~left], 2 * name + 1)]
    return pd.DataFrame({"id": ids, "node": node})


def leaves_by_count(rows: DataFrame, n_leaves: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, node): a tree of exactly so many leaves, of varying depth: the largest nodes are split first.

    There are fewer only where rows are equal. Of the tree that is split to its end the ``n_leaves`` - 1 largest inner nodes
    are kept; a parent is larger than its children, so they hang together, and a row's leaf is as deep as it has ancestors
    among them. Which they are follows from their places in order of size, by prefix sums over ranges.
    """
    ends = settled(split_down(rows, group_rows))
    ends = ends.withColumn("depth", F.length(F.bin("node")) - 1)
    above = ends.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda s: F.struct(s.alias("up"), F.call_function("shiftright", F.col("node"), s).alias("a")))).alias("x")).select("id", "x.up", "x.a")
    inner = above.groupBy("a").agg(F.count("*").alias("n"), F.max("up").alias("up")).where("up > 0").select("a", F.struct((-F.col("n")).alias("n"), "a").alias("key"))
    chosen = with_places(settled(inner), "key").where(F.col("place") < n_leaves - 1).select("a")
    held = above.join(chosen, "a", "left_semi").groupBy("id").agg(F.count("*").alias("c"))
    return ends.join(held, "id", "left").select("id", F.expr("shiftright(node, cast(depth - coalesce(c, 0) as int))").alias("node"))


def heads_by_ratio(rows: DataFrame, ratio: float = 0.2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(cid, c): heads for so large a share of the rows (id, v): of each of as many leaves the row nearest to its mean."""
    from nearlake.operators.graph import medoid

    if not 0 < ratio <= 1:
        raise ValueError("ratio must be above 0 and at most 1")
    kept = rows.select("id", "v").where("id IS NOT NULL AND v IS NOT NULL")
    leaves = settled(leaves_by_count(kept, max(1, round(ratio * kept.count())), group_rows))
    chosen = medoid(kept.join(leaves, "id"), "node").select("id")
    return kept.join(chosen, "id", "left_semi").select(F.col("id").alias("cid"), F.col("v").alias("c"))


# --- segment tree ---------------------------------------------------------------------------


def segment_features(v: Column, segments: int, width: int) -> Column:
    """Mean and deviation of each of ``segments`` runs of ``width`` components: mean 0, deviation 0, mean 1, ..."""
    pieces = [part(doubles(v), i * width, width) for i in range(segments)]
    return F.array(*(f(p) for p in pieces for f in (mean, deviation)))


def segment_boxes(leaves: DataFrame) -> DataFrame:
    """(node, low, high, n): the range of each feature f in each node."""
    size = leaves.select(F.size("f")).first()
    both = [f(F.col("f")[i]).alias(f"{name}{i}") for i in range(size[0] if size else 0) for name, f in (("lo", F.min), ("hi", F.max))]
    held = leaves.groupBy("node").agg(F.count("*").alias("n"), *both)
    names = range(len(both) // 2)
    return held.select("node", F.array(*(f"lo{i}" for i in names)).alias("low"), F.array(*(f"hi{i}" for i in names)).alias("high"), "n")


def segment_tree(rows: DataFrame, segments: int, width: int, depth: int, least: int = 2) -> DataFrame:
    """Adds f, the features of v, and node, the leaf: 1 is the root, 2 n and 2 n + 1 are the children of n.

    In each level a node of at least ``least`` rows is split at the middle of the range of one feature: of all
    segments' means and deviations the one whose range is the largest, ties to the first. A node whose rows agree in all
    features stays. A level is one aggregation of partial minima and maxima and one join with a row per node.
    """
    if not 0 <= depth <= MAX_DEPTH or segments < 1 or width < 1:
        raise ValueError(f"depth must be from 0 to {MAX_DEPTH}, segments and width positive")
    out = rows.withColumn("f", segment_features(F.col("v"), segments, width)).withColumn("node", F.lit(1).cast("long"))
    for _ in range(depth):
        out = settled(out)
        boxes_ = segment_boxes(out)
        ranges = F.zip_with("low", "high", lambda a, b: b - a)
        widest = boxes_.withColumn("r", ranges).withColumn("at", (F.array_position("r", F.array_max("r")) - 1).cast("int"))
        splits = widest.where((F.col("n") >= least) & (F.array_max("r") > 0)).select("node", "at", ((F.col("low")[F.col("at")] + F.col("high")[F.col("at")]) / 2).alias("middle"))
        side = F.when(F.col("f")[F.col("at")] < F.col("middle"), 0).otherwise(1)
        # at most 2 ** MAX_DEPTH splits
        out = out.join(F.broadcast(splits), "node", "left").withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(2 * F.col("node") + side)).drop("at", "middle")
    return out


def segment_search(leaves: DataFrame, queries: DataFrame, segments: int, width: int, k: int, first: int = 1) -> DataFrame:
    """(qid, rank, id, d): the k nearest, exactly, by leaves of a segment tree.

    Squared distance is at least the segments' width times the sum of squared differences of their means and deviations, so a
    leaf's ranges bound it from below. The ``first`` leaves of the least bounds give each query a k-th distance; then all
    leaves whose bound is within it are ranked. Leaves and queries meet by bounds alone, not by rows; a row is read for the
    queries that its leaf may serve.
    """
    leaves = settled(leaves.select("node", "id", "v", "f"))
    asked = queries.select("qid", "q", segment_features(F.col("q"), segments, width).alias("qf"))
    held = F.broadcast(segment_boxes(leaves))  # at most 2 ** MAX_DEPTH rows
    bounds = settled(asked.crossJoin(held).select("qid", "node", (width * lower_bound(F.col("qf"), F.col("low"), F.col("high")) * (1 - 1e-9)).alias("bound")))
    nearest = bounds.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("bound", "node"))).where(F.col("r") <= first)

    def ranked(visits: DataFrame) -> DataFrame:
        return search_leaves(leaves, visits, queries, k)

    reach = ranked(nearest).groupBy("qid").agg(F.max("d").alias("reach"), F.count("*").alias("n"))
    # fewer than k rows in the first leaves tell no distance: such a query visits all
    visits = settled(bounds.join(reach, "qid", "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") <= F.col("reach"))))
    return ranked(visits).select("qid", "rank", "id", "d")


def shards_for_budget(n_rows: int, bytes_per_row: int, budget: int) -> int:
    """Shards that each stay within a memory budget."""
    if min(n_rows, bytes_per_row, budget) <= 0:
        raise ValueError("sizes must be positive")
    return max(1, -(-n_rows * bytes_per_row // budget))


def chunks_for_budget(n_rows: int, dim: int, budget: int) -> int:
    """Bytes per code that fit a memory budget, from 1 to the dimension."""
    return max(1, min(dim, budget // max(1, n_rows)))
