"""Starts of k-means by squared distance, and partitions of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlake.functions.sampling import in_sample
from nearlake.functions.vectors import doubles
from nearlake.operators.knn import by_length, folded
from nearlake.operators.partition import lloyd, nearest_centroids
from nearlake.operators.tables import settled

#: Independent starts, of which the one with the least residual is kept.
REPETITIONS = 15


def uniform(seed: int, repetition: int, step: int) -> Column:
    """A number between 0 and 1 for each id, the same whenever it is computed."""
    bits = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(repetition), F.lit(step)), 11)
    return (bits + 0.5) / float(1 << 53)


def plus_plus(rows: DataFrame, k: int, repetitions: int = REPETITIONS, seed: int = 0) -> DataFrame:
    """(cid, c): up to k rows (id, v) as centroids, each drawn with probability in proportion to its squared distance to those before.

    A draw is a race: a row's time is -ln(u) / weight for a hash u of its id, and the first to arrive is drawn, which
    has exactly that probability. So a draw is one aggregation of minima, without an order of the rows or running sums
    over them, and all repetitions run at once: each step reads the rows, their weight in every repetition
    beside them, and writes them with new weights. The start kept is the one with the least sum of squared distances
    in the end, ties to the first. Fewer than k come back where rows are equal. Only the drawn rows, k x repetitions,
    come to the driver.
    """
    if k < 1 or repetitions < 1:
        raise ValueError("k and repetitions must be positive")
    spark = rows.sparkSession
    state = rows.select(F.col("id").cast("long").alias("id"), doubles(F.col("v")).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    state = state.withColumn("w", F.array_repeat(F.lit(1.0), repetitions))
    drawn: list[list[tuple[int, list[float]]]] = [[] for _ in range(repetitions)]
    totals = [0.0] * repetitions
    for step in range(k + 1):
        if step:
            state = settled(_closer(state, [x[-1] if len(x) == step else None for x in drawn], step == 1))
            sums = state.agg(*(F.sum(F.round(F.col("w")[r], 9)).alias(f"t{r}") for r in range(repetitions))).first()
            totals = [x or 0.0 for x in sums]
            if step == k:
                break
        race = (F.when(F.col("w")[r] > 0, -F.log(uniform(seed, r, step)) / F.col("w")[r]) for r in range(repetitions))
        first = state.agg(*(F.min(F.when(t.isNotNull(), F.struct(t.alias("t"), "id"))).alias(f"r{r}") for r, t in enumerate(race))).first()
        ids = {r: first[r].id for r in range(repetitions) if first[r] is not None}
        if not ids:
            break
        found = {x.id: x.v for x in state.where(F.col("id").isin(sorted(set(ids.values())))).select("id", "v").collect()}
        for r, i in ids.items():
            if len(drawn[r]) == step:
                drawn[r].append((i, found[i]))
    best = min(range(repetitions), key=lambda r: (totals[r], r))
    return spark.createDataFrame([(i, list(c)) for i, c in drawn[best]], "cid long, c array<double>")


def _closer(state: DataFrame, last: list[tuple[int, list[float]] | None], first: bool) -> DataFrame:
    """The state after each repetition's last drawn row: weights are the squared distances to the nearest one drawn."""
    vectors = [None if x is None else np.array(x[1]) for x in last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).copy()
            for n, at, v in by_length(np.arange(batch.num_rows), batch.column(1)):
                for r, c in enumerate(vectors):
                    if c is not None and len(c) == n:
                        d = folded(v, np.broadcast_to(c, v.shape))
                        w[at, r] = d if first else np.minimum(w[at, r], d)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(w), pa.list_(pa.float64()))], ["id", "v", "w"])

    return state.mapInArrow(run, "id long, v array<double>, w array<double>")


def fitting_partition(rows: DataFrame, budget: int, start: int = 3, step: int = 2, sample: int = 256_000, seed: int = 0) -> DataFrame:
    """(id, cid): rows by their nearest centroid, with as many centroids as it takes for every part to hold at most ``budget`` rows.

    Centroids come from a sample of about ``sample`` rows, a documented bound, whose parts tell how large those of the whole
    table will be; their number grows by ``step`` until the largest is expected to fit. Then the whole table is assigned
    and counted, and the number grows on if a part is larger than was expected. Rows that are equal beyond the budget can't be parted: an error.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")
    kept = rows.select("id", "v").where("v IS NOT NULL")
    n = kept.count()
    share = min(1.0, sample / max(1, n))
    some = settled(kept.where(in_sample(share, "id", seed=seed)))
    most = some.count()
    k = max(start, -(-n // budget))
    while k <= most + step:
        centroids = lloyd(some, plus_plus(some, min(k, most), 3, seed), 5)
        largest = lambda t: t.groupBy("cid").count().agg(F.max("count")).first()[0] or 0
        if largest(nearest_centroids(some, centroids)) <= budget * share:
            whole = settled(nearest_centroids(kept, centroids).select("id", "cid"))
            if largest(whole) <= budget:
                return whole
        k += step
    raise ValueError("no number of parts fits the budget")
