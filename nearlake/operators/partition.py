"""Segmentation of a data set into shards, centroids, and routing of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearlake.functions.sampling import in_sample
from nearlake.functions.vectors import doubles, l2
from nearlake.operators.knn import by_length, knn_by_group, nearest_pairs
from nearlake.operators.tables import settled

#: Centroids that are broadcast at once.
CENTROID_BLOCK = 65_536

#: The driver moves at most so many centroids in Lloyd's iterations.
MAX_CENTROIDS = 1_048_576

NEAR = "array<struct<d: double, cid: long>>"


def natural_split(rows: DataFrame, n_shards: int, key: str = "id") -> DataFrame:
    """Adds shard (from 0) and local (place in it): contiguous in key order, the first n mod s shards one row larger.

    Global places come from counts of key ranges, so no task sorts the whole table.
    """
    placed = with_places(rows, key)
    total = F.lit(rows.count())
    small, larger = F.floor(total / n_shards), total % n_shards
    edge = (small + 1) * larger
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / F.greatest(small, F.lit(1))))
    start = F.when(shard < larger, shard * (small + 1)).otherwise(edge + (shard - larger) * small)
    return placed.withColumn("shard", shard.cast("int")).withColumn("local", place - start).drop("place")


def in_ranges(rows: DataFrame, key: str) -> DataFrame:
    """Adds __part, the number of the range of keys that a row is in.

    The ranges' bounds come from a sample by a hash, about 50 keys for each range, so they are the
    same whenever a part of the plan runs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 50 * parts / max(1, rows.count()))
    sample = rows.select(F.col(key).alias("__key")).where(in_sample(share, "__key"))
    numbered = sample.agg(F.sort_array(F.collect_list("__key")).alias("__keys"))
    step = F.greatest(F.lit(1), F.floor(F.size("__keys") / parts).cast("int"))
    bounds = numbered.select(F.filter("__keys", lambda k, i: (i > 0) & (i % step == 0)).alias("__bounds"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("__part", F.size(F.filter("__bounds", lambda b: b <= F.col(key)))).drop("__bounds")


def with_places(rows: DataFrame, key: str = "id", name: str = "place") -> DataFrame:
    """Adds the place of each row in key order, from 0, by prefix sums over ranges of keys. Only windows within a range see its rows."""
    ranged = in_ranges(rows, key)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per range
    starts = counts.select(F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return ranged.withColumn("__within", within).join(starts, F.col("__part") == F.col("__of")).withColumn(name, F.col("__start") + F.col("__within")).drop("__part", "__of", "__start", "__within")


def nearest_centroids(rows: DataFrame, centroids: DataFrame, k: int = 1) -> DataFrame:
    """Adds rank, cid and cd: each row with its k nearest centroids (cid, c), k rows each.

    Distances come from matrix products over Arrow batches and are then folded exactly, as in ``knn``.
    Centroids are broadcast in blocks of ``CENTROID_BLOCK``, so what a task holds doesn't grow with their number: each
    block takes one pass over the rows, which carry their k nearest so far; nothing is shuffled. More
    than one pass is written between passes. Rows without a vector or of another length, or with a null component, are left out.
    """
    return ranked_centroids(rows, nearest_array(rows, centroids, k))


def ranked_centroids(rows: DataFrame, near: DataFrame) -> DataFrame:
    found = near.select(*rows.columns, F.posexplode("__near").alias("rank", "__one"))
    return found.select(*rows.columns, (F.col("rank") + 1).alias("rank"), F.col("__one.cid").alias("cid"), F.col("__one.d").alias("cd"))


def nearest_array(rows: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """Adds __near: the k nearest centroids of each row as an array of (d, cid), nearest first."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = rows.sparkSession
    kept = centroids.select(F.col("cid").cast("long").alias("cid"), doubles(F.col("c")).alias("c")).where("cid IS NOT NULL AND c IS NOT NULL")
    n_blocks = max(1, -(-kept.count() // CENTROID_BLOCK))
    near = rows.withColumn("__near", F.array().cast(NEAR))
    for i in range(n_blocks):
        some = kept if n_blocks == 1 else kept.where(F.pmod(F.xxhash64("cid"), F.lit(n_blocks)) == i)
        got = some.toArrow()  # at most about a block
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got.column(0), got.column(1))]
        held = spark.sparkContext.broadcast({n: x for n, *x in by_length(lists[0].to_numpy(), lists[1])} if got.num_rows else {})
        schema = T.StructType([f for f in near.schema if f.name != "__near"] + [near.schema["__near"]])

        def nearest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            books = held.value
            step = max(16, (1 << 21) // max([1, *(len(ids) for ids, _ in books.values())]))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    parts = [nearest_pairs(own, v, *books[n], k, False) for n, own, v in by_length(np.arange(batch.num_rows), batch.column(0)) if n in books]
                    row, cid, d = (np.concatenate([p[j] for p in parts] or [np.zeros(0, np.int64)]) for j in range(3))
                    before = batch.column(batch.num_columns - 1)
                    seen = np.repeat(np.arange(batch.num_rows), before.value_lengths().to_numpy(zero_copy_only=False))
                    if len(seen):
                        row = np.concatenate([row, seen])
                        cid = np.concatenate([cid, before.flatten().field("cid").to_numpy(zero_copy_only=False)])
                        d = np.concatenate([d, before.flatten().field("d").to_numpy(zero_copy_only=False)])
                    order = np.lexsort((cid, d, row))
                    row, cid, d = row[order], cid[order], d[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, cid, d = row[first], cid[first], d[first]
                    ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
                    pairs = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(cid, pa.int64())], ["d", "cid"])
                    columns = [*batch.columns[1:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

        near = near.select(doubles(F.col("v")).alias("__x"), *rows.columns, "__near").where("__x IS NOT NULL").mapInArrow(nearest, schema)
        if n_blocks > 1:
            near = settled(near)
    return near


def mean_vectors(assigned: DataFrame, key: str = "cid", digits: int = 9) -> DataFrame:
    """(key, c, n): mean vector of each group, component by component; rounded, as sums depend on row order."""
    parts = assigned.select(key, F.posexplode(doubles(F.col("v"))).alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.round(F.avg("x"), digits).alias("x"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))


def lloyd(rows: DataFrame, centroids: DataFrame, steps: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """k-means from the given centroids: steps until the residual changes by less than the tolerance.

    Centroids come to the driver after each step, which cuts the lineage; they are bounded by
    MAX_CENTROIDS. A centroid without rows stays where it is.
    """
    spark, schema = rows.sparkSession, "cid long, c array<double>"
    if centroids.count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    now, last = centroids.select("cid", doubles(F.col("c")).alias("c")), None
    for _ in range(steps):
        assigned = nearest_centroids(rows, now).select("cid", "v", "cd")
        residual = assigned.agg(F.sum("cd")).first()[0] or 0.0
        moved = mean_vectors(assigned).select("cid", "c")
        kept = now.join(moved.select("cid"), "cid", "left_anti")
        now = spark.createDataFrame(moved.unionByName(kept).collect(), schema)
        if last is not None and abs(last - residual) <= tolerance * max(last, 1e-30):
            break
        last = residual
    return now


def residuals(assigned: DataFrame, centroids: DataFrame, add: bool = False) -> DataFrame:
    """Adds r: v minus its centroid, or plus it."""
    sign = 1 if add else -1
    return assigned.join(centroids, "cid").withColumn("r", F.zip_with(doubles(F.col("v")), doubles(F.col("c")), lambda x, y: x + sign * y))


def merge_shards(results: list[DataFrame], k: int, distinct: bool = True) -> DataFrame:
    """Results (qid, id, d) of several shards as one ranking; an id found twice counts once, at its least distance."""
    both = reduce(DataFrame.unionByName, results)
    if distinct:
        both = both.groupBy("qid", "id").agg(F.min("d").alias("d"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("d", "id")))
    return ranked.where(F.col("rank") <= k)


def concatenated_ranking(results: list[DataFrame], k: int, fill: bool = False) -> DataFrame:
    """Result tables (qid, id, d) of several shards as one ranking by distance alone; an id that several have counts each time.

    ``fill`` gives every query k rows: those that are missing have the id 0 and no distance. Ties go to the earlier table, then the smaller id.
    """
    numbered = [r.select("qid", "id", "d", F.lit(i).alias("table")) for i, r in enumerate(results)]
    both = reduce(DataFrame.unionByName, numbered)
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("d", "table", "id"))).where(F.col("rank") <= k).select("qid", "rank", "id", "d")
    if not fill:
        return ranked
    places = both.select("qid").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return places.join(ranked, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("id", F.lit(0)).alias("id"), "d")


def search_shards(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, d): shards (shard, id, v) that may hold the same row are searched in one scan, and their k best merged.

    A row found in several shards counts once.
    """
    return merge_shards([knn_by_group(rows, queries, k, "shard").select("qid", "id", "d")], k)


def split_at_middle(rows: DataFrame, value: str) -> DataFrame:
    """Adds left: whether the value is below the middle of its range, the split of a segment tree's node."""
    middle = rows.agg(((F.max(value) + F.min(value)) / 2).alias("__middle"))
    return rows.crossJoin(F.broadcast(middle)).withColumn("left", F.col(value) < F.col("__middle")).drop("__middle")
