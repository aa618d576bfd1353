"""Inverted-list search: heads, postings, probes, exact re-ranking, and adaptive scans of shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.vectors import doubles, l2
from nearlake.operators.knn import folded, knn_by_group, top_k
from nearlake.operators.partition import CENTROID_BLOCK, nearest_array, nearest_centroids
from nearlake.operators.tables import settled


#: Fixed value: limits up to this one prune no heads.
LEAST_LIMIT = 0.1


def postings(rows: DataFrame, heads: DataFrame, replicas: int = 8, limit: int | None = None) -> DataFrame:
    """(cid, id, cd, v): each row in the lists of its ``replicas`` nearest heads; of a list the nearest ``limit`` stay."""
    placed = nearest_centroids(rows.select("id", "v"), heads, replicas).select("cid", "id", "cd", "v")
    return placed if limit is None else top_k(placed, limit, "cid", ("cd", "id")).drop("rank")


def spread_postings(rows: DataFrame, heads: DataFrame, replicas: int = 8, candidates: int = 32, factor: float = 1.0, limit: int | None = None) -> DataFrame:
    """(cid, id, cd): each row in the lists of at most ``replicas`` heads that lie in different directions from it.

    Of the ``candidates`` nearest heads, nearest first, one is dropped if ``factor`` times its distance to a kept one is no
    more than its distance to the row: that row is found by way of the kept head. Of a list the nearest ``limit``
    rows stay. Heads' vectors are looked up in the broadcast heads; where these are more than a block, they are joined.
    """
    if not 1 <= replicas <= candidates:
        raise ValueError("replicas must be from 1 to the number of candidates")
    heads = heads.select(F.col("cid").cast("long").alias("cid"), doubles(F.col("c")).alias("c")).where("cid IS NOT NULL AND c IS NOT NULL")
    near = nearest_array(rows.select("id", "v"), heads, candidates).select("id", "__near")
    if heads.count() <= CENTROID_BLOCK:
        got = heads.orderBy("cid").toArrow().combine_chunks()
        held = rows.sparkSession.sparkContext.broadcast((got.column(0).to_numpy(), list(got.column(1).to_pylist())))
    else:
        each = near.select("id", F.inline("__near")).join(heads, "cid").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "cid", "c"))).alias("__near"))
        near, held = each.select("id", F.transform("__near", lambda x: F.struct(x["d"].alias("d"), x["cid"].alias("cid"))).alias("__near"), F.transform("__near", lambda x: x["c"]).alias("__c")), None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            lists = batch.column(1).to_pylist()
            for i, (own, found) in enumerate(zip(ids, lists)):
                d, cid = np.array([x["d"] for x in found]), np.array([x["cid"] for x in found], np.int64)
                if held is None:
                    c = np.array(batch.column(2)[i].as_py(), float)
                else:
                    names, vectors = held.value
                    c = np.array([vectors[at] for at in np.searchsorted(names, cid)], float)
                out += [(int(cid[j]), own, float(d[j])) for j in unoccluded(d, c, replicas, factor)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["cid", "id", "cd"])

    placed = near.mapInArrow(choose, "cid long, id long, cd double")
    return placed if limit is None else top_k(placed, limit, "cid", ("cd", "id")).drop("rank")


def unoccluded(d: np.ndarray, c: np.ndarray, most: int, factor: float) -> list[int]:
    """The places of the heads c, in order of their distances d, that no kept one occludes."""
    kept: list[int] = []
    for j in range(len(d)):
        if len(kept) == most:
            break
        if not kept or (factor * folded(c[kept], np.broadcast_to(c[j], (len(kept), c.shape[1]))) > d[j]).all():
            kept.append(j)
    return kept


def probes(queries: DataFrame, heads: DataFrame, n: int, max_ratio: float = 10_000.0) -> DataFrame:
    """(qid, cid, hd): the n nearest heads of each query, none farther than ``max_ratio`` times the nearest.

    Where that product is at most 0.1, so where a query all but is a head, nothing is left out.
    """
    near = nearest_centroids(queries.select("qid", F.col("q").alias("v")), heads, n)
    nearest = F.min("cd").over(W.partitionBy("qid"))
    return near.withColumn("__m", nearest).where((max_ratio * F.col("__m") <= LEAST_LIMIT) | (F.col("cd") <= max_ratio * F.col("__m"))).select("qid", "cid", F.col("cd").alias("hd"))


def search(rows: DataFrame, lists: DataFrame, probed: DataFrame, queries: DataFrame, k: int, replicas: int | None = None) -> DataFrame:
    """(qid, rank, id, d): exact ranking of all rows in the probed lists. A row in several lists counts once.

    Lists that hold the vectors (cid, id, v) are scored where they are read: they meet their probes by cid, and of each query
    the best k * replicas rows, among which k different ones are, go on. Lists of ids alone are joined with the rows.
    ``replicas`` is how often a row may be in lists; unknown, all repeats are dropped before ranking.
    """
    asked = probed.select("cid", "qid").join(queries.select("qid", "q"), "qid")
    if "v" in lists.columns:
        near = lists.select("cid", "id", "v").join(asked, "cid").select("qid", "id", l2(F.col("v"), F.col("q")).alias("d"))
        if replicas:
            near = top_k(near, k * replicas).drop("rank")
        return top_k(near.groupBy("qid", "id").agg(F.min("d").alias("d")), k)
    candidates = lists.select("cid", "id").join(probed.select("cid", "qid"), "cid").select("qid", "id").distinct()
    scored = candidates.join(rows.select("id", "v"), "id").join(queries.select("qid", "q"), "qid")
    return top_k(scored.select("qid", "id", l2(F.col("v"), F.col("q")).alias("d")), k)


def rerank(approximate: DataFrame, rows: DataFrame, queries: DataFrame, first: int, k: int) -> DataFrame:
    """The best ``first`` by approximate distance, ranked by the exact one. Vectors are fetched for these alone."""
    best = top_k(approximate, first).select("qid", "id")
    scored = best.join(rows.select("id", "v"), "id").join(queries.select("qid", "q"), "qid")
    return top_k(scored.select("qid", "id", l2(F.col("v"), F.col("q")).alias("d")), k)


def adaptive_depths(ranked: DataFrame, k: int, start: int, big: int, small: int, end: int) -> DataFrame:
    """(qid, shard, depth) after adaptive rounds over shard rankings (qid, shard, id, d, place from 1).

    All shards start at depth ``start``. While a query's depths sum to less than ``end``, shards
    that own some of its best k so far go ``big`` deeper, the others ``small``. Only depths, one
    number per query and shard, pass from round to round; a query that is done keeps its depths. Every round adds
    ``small`` to each shard at least, which bounds their number; every fourth one is written.
    """
    if min(big, small) < 1:
        raise ValueError("big and small must be positive")
    shards = settled(ranked.select("qid", "shard").distinct())
    n = shards.groupBy("qid").count().agg(F.min("count")).first()[0] or 0
    state = shards.select("qid", "shard", F.lit(start).alias("depth"))
    rounds = 0
    while n and n * (start + rounds * small) < end:
        seen = ranked.join(state, ["qid", "shard"]).where(F.col("place") <= F.col("depth"))
        own = top_k(seen.select("qid", "shard", "id", "d"), k).select("qid", "shard").distinct().withColumn("own", F.lit(True))
        total = F.sum("depth").over(W.partitionBy("qid"))
        grown = F.when(F.col("total") < end, F.col("depth") + F.when(F.col("own"), big).otherwise(small)).otherwise(F.col("depth"))
        state = state.join(own, ["qid", "shard"], "left").withColumn("total", total).select("qid", "shard", grown.alias("depth"))
        rounds += 1
        if rounds % 4 == 0:
            state = settled(state)
    return state


def radius_rounds(ranked: DataFrame, k: int, start: int, step: int, capacity: int, factor: float = 1.0) -> DataFrame:
    """(qid, shard, depth): depths by radius over shard rankings (qid, shard, id, d, place from 1).

    All shards are read to depth ``start``. The radius of a query is ``factor`` times the k-th
    distance among these; a shard goes on in steps of ``step`` as long as the last row that it
    gave lies within the radius, up to ``capacity`` rows. One window per query and one per shard
    tell all depths at once.
    """
    first = ranked.where(F.col("place") <= start)
    radius = top_k(first.select("qid", "id", "d"), k).groupBy("qid").agg((F.max("d") * factor).alias("radius"))
    # the first place, of those at which a shard decides, whose row is beyond the radius
    decides = (F.col("place") >= start) & ((F.col("place") - start) % step == 0)
    beyond = ranked.where(decides).join(radius, "qid").where(F.col("d") > F.col("radius")).groupBy("qid", "shard").agg(F.min("place").alias("stop"))
    last = ranked.groupBy("qid", "shard").agg(F.max("place").alias("rows"))
    depth = F.least(F.coalesce("stop", F.lit(capacity)), F.lit(capacity), F.col("rows"))
    return last.join(beyond, ["qid", "shard"], "left").select("qid", "shard", depth.alias("depth"))


def adaptive_search(rows: DataFrame, queries: DataFrame, k: int, start: int, big: int, small: int, end: int) -> DataFrame:
    """Rounds of ``adaptive_depths`` over exact rankings of the shards of rows (shard, id, v), then the best k within the depths.

    All shards are ranked in one scan, as deep as a round can reach.
    """
    # every round reads it; it has at most queries x shards x (end + big) rows
    ranked = settled(knn_by_group(rows, queries, end + big, "shard"))
    depths = adaptive_depths(ranked, k, start, big, small, end)
    return top_k(ranked.join(depths, ["qid", "shard"]).where(F.col("place") <= F.col("depth")), k).select("qid", "rank", "id", "shard", "d")
