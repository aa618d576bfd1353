"""Proximity graphs as edge tables (src, dst): building, pruning, traversal, page layouts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.vectors import doubles, l2
from nearlake.operators.knn import by_length, knn_by_matrix, top_k
from nearlake.operators.partition import with_places
from nearlake.operators.tables import settled


#: Rows that are broadcast as queries at once.
GRAPH_BLOCK = 16_384


def knn_graph(rows: DataFrame, k: int) -> DataFrame:
    """(src, dst, d): each row's k nearest others. Rows are queries too, in blocks of ``GRAPH_BLOCK``, each of which takes a scan.

    Exact, so its work is quadratic; a graph of very many rows grows by insertion (``frontier.grow_graph``).
    """
    queries = rows.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    found = knn_by_matrix(rows.select("id", "v"), queries, k, GRAPH_BLOCK, skip_self=True)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "d")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each pair of ends once a way."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def pruned(candidates: DataFrame, rows: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """(src, dst, d): candidates (src, dst, d) in distance order, less those that a kept one occludes.

    dst goes if some kept neighbour n has alpha * d(n, dst) < d. Candidates of a source are of
    bounded number; their vectors are brought along by a join, and the sources of a batch are pruned together.
    """
    vectors = rows.select(F.col("id").alias("dst"), "v")
    near = candidates.join(vectors, "dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("d").cast("double"), "v")
    near = near.repartition("src").sortWithinPartitions("src", "d", "dst").withColumn("v", doubles(F.col("v")))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            for _, place, v in by_length(np.arange(table.num_rows), table.column("v")):
                kept = place[unoccluded(table.column("src").to_numpy()[place], table.column("d").to_numpy()[place], v, degree, alpha)]
                yield table.select(["src", "dst", "d"]).take(pa.array(kept))

    return near.mapInArrow(prune, "src long, dst long, d double")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their first column, cut so that equal values of it stay together."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if waiting and waiting[-1].column(0)[-1].as_py() != key[0]:
            yield joined(waiting)
            waiting = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield joined([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield joined(waiting)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Numbers of the candidates that are pruned together.
PRUNED_AT_ONCE = 1 << 20


def unoccluded(src: np.ndarray, d: np.ndarray, v: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Which candidates of each source stay; those of one source stand together, in distance order."""
    starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    counts = np.diff(np.append(starts, len(src)))
    kept, order, at = np.zeros(len(src), bool), np.argsort(-counts, kind="stable"), 0
    while at < len(order):
        most = counts[order[at]]
        some = order[at : at + max(1, PRUNED_AT_ONCE // max(1, most * v.shape[1]))]
        at += len(some)
        there = np.arange(most)[None, :] < counts[some][:, None]
        place = np.where(there, starts[some][:, None] + np.arange(most)[None, :], starts[some][:, None])
        x, far, stays = v[place], d[place], np.zeros(place.shape, bool)
        for i in range(most):
            between = ((x[:, :i] - x[:, i : i + 1]) ** 2).sum(axis=2)
            clear = ((alpha * between >= far[:, i : i + 1]) | ~stays[:, :i]).all(axis=1)
            stays[:, i] = there[:, i] & clear & (stays.sum(axis=1) < degree)
        kept[place[stays]] = True
    return kept


def stitched(rows: DataFrame, k: int, degree: int, alpha: float = 1.2) -> DataFrame:
    """Graph of rows with labels: k nearest others within each label, united, then pruned.

    Each label's rows are searched by matrix products, block by block, so no label is joined with itself; labels
    come to the driver, as many as there are. Rows without a label are in no graph of a label.
    """
    kept = settled(rows.select("id", "v", "label"))
    labels = [r[0] for r in kept.select("label").distinct().where("label IS NOT NULL").orderBy("label").collect()]
    parts = [knn_graph(kept.where(F.col("label") == x), k) for x in labels]
    if not parts:
        return rows.sparkSession.createDataFrame([], "src long, dst long, d double")
    near = reduce(DataFrame.unionByName, parts)
    near = near.groupBy("src", "dst").agg(F.min("d").alias("d"))
    near = top_k(near, k, "src", ("d", "dst")).drop("rank")
    return pruned(near, rows, degree, alpha)


def local_ids(members: DataFrame) -> DataFrame:
    """(shard, local, id): the rows (shard, id) of each shard numbered from 0 in order of their ids, by prefix sums over ranges."""
    placed = settled(with_places(members.select(F.struct("shard", "id").alias("key")), "key"))
    starts = placed.groupBy(F.col("key.shard").alias("shard")).agg(F.min("place").alias("start"))  # a row per shard
    return placed.select("key.shard", "key.id", "place").join(starts, "shard").select("shard", (F.col("place") - F.col("start")).alias("local"), "id")


def merged_shard_graphs(edges: DataFrame, ids: DataFrame, degree: int) -> DataFrame:
    """(src, dst, d): graphs of shards that may share rows as one. edges has (shard, src, dst, d) in local ids, ids (shard, local, id).

    An edge that several shards have counts once; of a node's edges the ``degree`` nearest stay, ties to the smaller id.
    """
    named = edges.join(ids.select("shard", F.col("local").alias("src"), F.col("id").alias("from")), ["shard", "src"]).join(ids.select("shard", F.col("local").alias("dst"), F.col("id").alias("to")), ["shard", "dst"])
    once = named.where(F.col("from") != F.col("to")).groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.min("d").alias("d"))
    return top_k(once, degree, "src", ("d", "dst")).select("src", "dst", "d")


def levels(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, level): least number of steps from the start ids, up to ``depth``."""
    edges = settled(edges.select("src", "dst"))
    reached = start.select("id", F.lit(0).alias("level"))
    frontier = reached
    for step in range(1, depth + 1):
        next_ids = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        # settled, as the next step reads it twice
        frontier = settled(next_ids.join(reached.select("id"), "id", "left_anti").withColumn("level", F.lit(step)))
        reached = reached.unionByName(frontier)
    return reached


def medoid(rows: DataFrame, by: str | None = None) -> DataFrame:
    """The row nearest to the mean of all rows, or of each group: (by, id). Means are rounded, ties go to the smaller id."""
    from nearlake.operators.partition import mean_vectors

    keyed = rows.withColumn("__k", F.col(by) if by else F.lit(0))
    means = mean_vectors(keyed, "__k").select("__k", "c")
    near = keyed.join(means if by else F.broadcast(means), "__k").groupBy("__k").agg(F.min(F.struct(F.round(l2(F.col("v"), F.col("c")), 9).alias("d"), F.col("id").alias("id")))["id"].alias("id"))
    return near.select(F.col("__k").alias(by), "id") if by else near.select("id")


def page_overlap(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean over nodes of the share of their page mates that they link to; alone on a page counts 0."""
    sizes = pages.groupBy("page").agg(F.count("*").alias("n"))
    src = pages.select(F.col("id").alias("src"), F.col("page").alias("sp"))
    dst = pages.select(F.col("id").alias("dst"), F.col("page").alias("dp"))
    together = edges.join(src, "src").join(dst, "dst").where("sp = dp").groupBy("src").agg(F.count("*").alias("c"))
    each = pages.join(sizes, "page").join(together.withColumnRenamed("src", "id"), "id", "left")
    share = F.when(F.col("n") > 1, F.coalesce("c", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0)
    return each.agg(F.round(F.avg(share), 9).alias("overlap"))


def pages_by_growth(edges: DataFrame, frequency: DataFrame, capacity: int) -> DataFrame:
    """(id, page): pages filled with a node and then its neighbours that are free, in order of their ids, often visited nodes first.

    frequency has (id, freq). A page is named by the node that it began with. Nodes are taken in rounds: one may begin its page
    once no earlier free node could touch the same nodes, that is, none within two steps, whichever way edges point. That
    gives what taking all nodes in one order does. A round is a few joins on nodes; its number grows with the longest run of
    ever later nodes that touch each other.
    """
    edges = settled(edges.select("src", "dst").where("src <> dst").distinct())
    free = settled(frequency.select("id", F.struct((-F.col("freq")).alias("f"), "id").alias("turn")))
    done = []
    while True:
        here = edges.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi")
        here = settled(here.select("src", "dst"))
        # the first turn that could take a node: its own, or that of a free node with an edge to it
        own = free.select(F.col("id").alias("node"), "turn")
        claims = own.unionByName(here.join(free.toDF("src", "turn"), "src").select(F.col("dst").alias("node"), "turn"))
        first = claims.groupBy("node").agg(F.min("turn").alias("first"))
        # a node begins its page if it is the first at all nodes that it could take
        touched = free.select("id", F.col("id").alias("node"), "turn").unionByName(here.join(free.toDF("src", "turn"), "src").select(F.col("src").alias("id"), F.col("dst").alias("node"), "turn"))
        begins = touched.join(first, "node").groupBy("id").agg(F.max(F.col("first") < F.col("turn")).alias("late")).where("NOT late").select(F.col("id").alias("src"))
        room = top_k(begins.join(here, "src"), capacity - 1, "src", ("dst",)) if capacity > 1 else None
        pages = begins.select(F.col("src").alias("id"), F.col("src").alias("page"))
        if room is not None:
            pages = pages.unionByName(room.select(F.col("dst").alias("id"), F.col("src").alias("page")))
        pages = settled(pages)
        if pages.isEmpty():
            break
        done.append(pages)
        free = settled(free.join(pages.select("id"), "id", "left_anti"))
    return reduce(DataFrame.unionByName, done) if done else free.select("id", F.col("id").alias("page"))


def pages_by_votes(edges: DataFrame, nodes: DataFrame, capacity: int, rounds: int) -> DataFrame:
    """(id, page): pages of at most ``capacity`` nodes that link to each other, by rounds of greedy placement.

    Pages begin as runs of ids. In each round every node votes for the page where most of its neighbours, out and in, are;
    of those who chose a page its most linked ones are
    placed, up to its capacity. The others take the places that are left, in order of their ids. All nodes choose at once by
    the places of the round before, so a round is an aggregation by node and one by page; places that are left are numbered by
    prefix sums. Ties go to the smaller page and the smaller id.
    """
    links = settled(both_ways(edges))
    placed = with_places(nodes.select("id"))
    pages = settled(placed.select("id", F.floor(F.col("place") / capacity).alias("page")))
    n_pages = -(-pages.count() // capacity)
    for _ in range(rounds):
        votes = links.join(pages.withColumnRenamed("id", "dst"), "dst").groupBy("src", "page").agg(F.count("*").alias("c"))
        choice = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("c")).alias("c"), "page")).alias("x")).select("id", "x.page", "x.c")
        taken = settled(top_k(choice, capacity, "page", ("c", "id")).select("id", "page"))
        others = with_places(pages.select("id").join(taken.select("id"), "id", "left_anti"))
        sizes = taken.groupBy("page").agg(F.count("*").alias("n"))
        every = nodes.sparkSession.range(n_pages).select(F.col("id").alias("page")).join(sizes, "page", "left")
        room = every.select("page", (capacity - F.coalesce("n", F.lit(0))).alias("room")).where("room > 0")
        slots = room.select("page", F.explode(F.sequence(F.lit(1), F.col("room").cast("int"))).alias("slot")).select(F.struct("page", "slot").alias("key"))
        filled = others.join(with_places(slots, "key"), "place").select("id", "key.page")
        pages = settled(taken.unionByName(filled))
    return pages


def heavy_edge_pages(edges: DataFrame, capacity: int) -> DataFrame:
    """(id, page): ends of heavy edges (src, dst, w) join pages of at most ``capacity``, the heaviest first.

    In each round the pages that are each other's heaviest choice with room for both join. Pages
    only grow, so that gives what going through all edges in one order does, without a task that
    holds them all. The rounds are as many as the longest run of ever heavier edges needs.
    """
    edges = settled(edges.select("src", "dst", "w"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    pages = settled(ends.withColumn("page", F.col("id")))
    open_edges = edges.select((-F.col("w")).alias("rank"), "src", "dst", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    while True:
        sizes = pages.groupBy("page").agg(F.count("*").alias("n"))
        both = open_edges.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").where(F.col("n_a") + F.col("n_b") <= capacity)
        open_edges = settled(both.select("rank", "src", "dst", "a", "b"))
        choices = open_edges.select(F.explode(F.array("a", "b")).alias("page"), F.struct("rank", "src", "dst", "a", "b").alias("e"))
        mutual = choices.groupBy("page").agg(F.min("e").alias("e")).groupBy("e").count().where("count = 2")
        joined = settled(mutual.select(F.greatest("e.a", "e.b").alias("page"), F.least("e.a", "e.b").alias("to")))
        if joined.isEmpty():
            return pages
        pages = settled(pages.join(joined, "page", "left").select("id", F.coalesce("to", "page").alias("page")))
        for c in ("a", "b"):
            open_edges = open_edges.join(joined.toDF(c, "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        open_edges = open_edges.where("a <> b")
