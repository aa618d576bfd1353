"""Exact nearest neighbours: joins of a base table with a table of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.vectors import doubles, metric
from nearlake.operators.pairs import METHODS, Method, every_pair

#: Most queries that are broadcast at once; more are joined block by block.
QUERY_BLOCK = 4_096

#: Rows that a task holds for all queries of a block and each group: with greater k a block has fewer queries.
HELD_ROWS = 1 << 19

PAIRS = "qid long, id long, d double"


def top_k(scored: DataFrame, k: int, group: str = "qid", order: tuple[str, ...] = ("d", "id")) -> DataFrame:
    """The k first rows of each group, with their rank from 1. Ties in d go to the smaller id.

    A bound on a row number lets Spark keep k rows per group and task before the shuffle.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, block: int = QUERY_BLOCK) -> list[DataFrame]:
    """The queries in parts that may be broadcast: at most about ``block`` rows each."""
    n = -(-queries.count() // block)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def scored_pairs(base: DataFrame, queries: DataFrame, distance: str = "l2", condition: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Every query against every base row: (qid, id, d) and the other base columns.

    base has (id, v), queries (qid, q). Only the stated queries are broadcast, in blocks.
    """
    d = metric(distance)
    pairs = paired(base, queries, block)
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.withColumn("d", d(F.col("v"), F.col("q"))).drop("v", "q")


def paired(base: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Every base row beside every stated query, which are broadcast in blocks of about ``block`` rows."""
    return reduce(DataFrame.unionByName, (base.crossJoin(F.broadcast(some)) for some in query_blocks(queries, block)))


def knn(
    base: DataFrame, queries: DataFrame, k: int, distance: str | Method = "l2", condition: Column | None = None, block: int = QUERY_BLOCK, skip_self: bool = False, same: tuple[str, str] | None = None
) -> DataFrame:
    """(qid, rank, id, d): the k nearest base rows of each query.

    What may be a neighbour is told before the ranking, so k rows come back whenever k fit: ``skip_self`` leaves out
    the row with a query's own id, ``same`` names whole-number columns of base and queries that must be equal, and
    ``condition`` is any other one on base and query columns. Matrix products choose, and what they choose is folded like
    all else, so they are the same numbers; only a condition or a distance without a method is looked at pair by pair. A pair
    without a distance (a vector that is null or has a null component, unequal lengths) is left out; a distance
    that is no number is the greatest.
    """
    if condition is None and (isinstance(distance, Method) or distance in METHODS):
        if k < 1:
            raise ValueError("k must be positive")
        found = matrix_pairs(base, queries, k, block, skip_self, *(same or (None, None)), how=distance)
        return top_k(found.drop("by"), k).select("qid", "rank", "id", "d")
    rules = [condition] if condition is not None else []
    rules += [F.col("id") != F.col("qid")] if skip_self else []
    rules += [F.col(same[0]) == F.col(same[1])] if same else []
    pairs = scored_pairs(base, queries, distance, reduce(lambda a, b: a & b, rules) if rules else None, block).select("qid", "id", "d").where("d IS NOT NULL")
    return top_k(pairs, k).select("qid", "rank", "id", "d")


def next_nearest(base: DataFrame, queries: DataFrame, last: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, rank, id, d): the k nearest rows that come after (ld, lid) in the order of (d, id). last is (qid, ld, lid)."""
    if k < 1:
        raise ValueError("k must be positive")
    return top_k(matrix_pairs(base, queries.join(last, "qid"), k, block, after=("ld", "lid")).drop("by"), k).select("qid", "rank", "id", "d")


def within(base: DataFrame, queries: DataFrame, radius: Column | float, distance: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, d) for all base rows within the radius, a number or a column of the queries."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    if distance not in METHODS:
        pairs = scored_pairs(base, queries, distance, None, block)
        return pairs.where(F.col("d") <= r).select("qid", "id", "d")
    how = METHODS[distance]

    def found(ids: np.ndarray, own: np.ndarray, q: np.ndarray, v: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            one, other, _ = may_lie_within(how, q, v, r, False)
            d = exact_pairs(how, q, v, one, other)
            inside = (d <= r[one]) | np.isnan(r[one])
        yield pa.RecordBatch.from_arrays([pa.array(x[inside]) for x in (ids[one], own[other], d)], ["qid", "id", "d"])

    return blocks_of_pairs(base, queries.withColumn("__r", r.cast("double")).where("__r IS NOT NULL"), found, PAIRS, block, ("__r",))


def counts_within(base: DataFrame, queries: DataFrame, radius: Column | float, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, n): how many base rows lie within the squared radius of each query; no row for a query with none.

    Products decide all but the pairs at the margin. Counts alone leave a task.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    how = METHODS["l2"]

    def count(ids: np.ndarray, own: np.ndarray, q: np.ndarray, v: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            one, other, n = may_lie_within(how, q, v, r, True)
            inside = (exact_pairs(how, q, v, one, other) <= r[one]) | np.isnan(r[one])
        n += np.bincount(one[inside], minlength=len(q))
        yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["qid", "n"])

    counted = blocks_of_pairs(base, queries.withColumn("__r", r.cast("double")).where("__r IS NOT NULL"), count, "qid long, n long", block, ("__r",))
    return counted.groupBy("qid").agg(F.sum("n").alias("n"))


def pairs_below(base: DataFrame, queries: DataFrame, how: Method, limit: float, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, d) for all pairs whose distance is less than the limit; a task holds one block of pairs at a time."""

    def found(ids: np.ndarray, own: np.ndarray, q: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, d in every_pair(how, q, v):
            other, one = np.nonzero(d.T < limit)  # the pairs of a row together: there are fewer queries in a block than rows in a task, so they are stored in less
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at][one], own[other], d[one, other])], ["qid", "id", "d"])

    return blocks_of_pairs(base, queries, found, PAIRS, block, ())


def all_pairs(base: DataFrame, queries: DataFrame, how: Method, kind: str = "double", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, id, d) for every query and every base row; d is null where a pair has no distance.

    A row per pair is what is asked for, so the work is rows times queries, but a task holds one block of them at a time.
    """

    def score(ids: np.ndarray, own: np.ndarray, q: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, d in every_pair(how, q, v):
            d = d.ravel().astype(np.int32 if kind == "int" else float)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], len(own))), pa.array(np.tile(own, len(ids[at]))), pa.array(d)], ["qid", "id", "d"])

    def none(ids: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 16) // max(1, len(own)))
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            columns = np.repeat(some, len(own)), np.tile(own, len(some))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.nulls(len(columns[0]), pa.int32() if kind == "int" else pa.float64())], ["qid", "id", "d"])

    return blocks_of_pairs(base, queries, score, f"qid long, id long, d {kind}", block, (), none)


def blocks_of_pairs(base: DataFrame, queries: DataFrame, each: Callable[..., Iterator[pa.RecordBatch]], schema: str, block: int, more: tuple[str, ...], none: Callable[..., Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """What ``each`` yields for the queries of a block and the rows of a batch whose vectors are whole and of one length.

    each gets ids of queries and rows, matrices of both, and the columns ``more`` of the queries. ``none`` gets ids of the pairs without a
    distance, for a null vector, a null component or unequal lengths; unless it is given, they are left out.
    """
    parts = []
    spread = max(2, 2 * base.sparkSession.sparkContext.defaultParallelism)
    # dealt once for all blocks, as they are stored: doubled vectors would be dealt in twice the bytes
    rows_with = base.select(F.col("id").cast("long").alias("id"), "v").repartition(spread).select("id", doubles(F.col("v")).alias("v"))
    for some in query_blocks(queries, block):
        rows = some.select(F.col("qid").cast("long"), doubles(F.col("q")).alias("q"), *more).collect()  # at most about a block
        if not rows:
            continue
        values = [np.array([r[2 + i] for r in rows], float) for i in range(len(more))]
        qids, vectors = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))
        whole = {n: (place, q) for n, place, q in by_length(np.arange(len(rows)), vectors)}
        held = base.sparkSession.sparkContext.broadcast((qids, whole, values))

        def scored(batches: Iterator[pa.RecordBatch], held=held, n_rows=len(rows)) -> Iterator[pa.RecordBatch]:
            qids, whole, values = held.value
            step = max(64, min(1024, (1 << 22) // n_rows))
            for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                left = np.ones((n_rows, batch.num_rows), bool) if none else None
                for n, place, v in by_length(np.arange(batch.num_rows), batch.column(1)):
                    if n in whole:
                        at, q = whole[n]
                        yield from named(each(at, place, q, v, *(x[at] for x in values)), qids, batch.column(0))
                        if none:
                            left[np.ix_(at, place)] = False
                if none and left.any():
                    for i in np.flatnonzero(left.any(axis=1)):
                        yield from named(none(np.array([i]), np.flatnonzero(left[i])), qids, batch.column(0))

        parts.append(rows_with.mapInArrow(scored, schema))
    return reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], schema)


def named(batches: Iterator[pa.RecordBatch], qids: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
    """Batches whose columns qid and id are places, with the ids in their stead: these may be null or repeat."""
    for batch in batches:
        columns = [{"qid": qids, "id": own}[c].take(batch.column(i)) if c in ("qid", "id") else batch.column(i) for i, c in enumerate(batch.schema.names)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed from left to right as in ``functions.vectors``."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        step = a[:, i] - b[:, i]
        out += step * step
    return out


#: Queries whose products with the rows of a batch are looked at together, and most rows of such a batch.
COARSE_QUERIES, COARSE_ROWS = 512, 2_048

#: Pairs whose distances are held in double precision.
PLAIN_PAIRS = 1 << 21

#: Squared lengths that single precision takes.
COARSE_SQUARES = 1e-30, 1e30

#: Pairs times components that are folded at once: 32 MB a side.
FOLD_AT_ONCE = 1 << 22


def nearest_places(
    qids: np.ndarray,
    q: np.ndarray,
    own: np.ndarray,
    v: np.ndarray,
    k: int,
    skip_self: bool = False,
    bound: np.ndarray | None = None,
    how: Method = METHODS["l2"],
    after: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, row ids, distances): of these rows the k nearest to each query, exactly folded, ties to the smaller id.

    The matrix product tells each distance up to a margin; a row is folded if its least possible
    distance is no more than the k-th greatest possible one, nor than ``bound``, the query's k-th distance so far. Squared distances
    that aren't finite numbers come last, NaN after infinity, so they are found only where k others aren't there. With
    ``after``, a distance and an id of each query, only rows that come later in the order count.
    """
    with np.errstate(all="ignore"):
        margin, low, high = possible(how, q, v)
        if skip_self:
            same = qids[:, None] == own[None, :]
            high[same] = low[same] = np.inf
        if after is not None:
            # rows that may come before or after are folded and tell nothing about the k-th
            last = after[0][:, None]
            gone, sure = high + margin[:, None] < last, low - margin[:, None] > last
            low, high = np.where(gone, np.inf, low), np.where(sure, high, np.inf)
        if bound is None or not np.isfinite(bound).all():
            m = min(k, len(own))
            limit = np.partition(high, m - 1, axis=1)[:, m - 1] + margin
            limit = limit if bound is None else np.minimum(limit, bound)
        else:
            limit = bound
        one, other = np.nonzero(low <= (limit + margin)[:, None])
        if skip_self:
            fair = qids[one] != own[other]
            one, other = one[fair], other[fair]
        exact = exact_pairs(how, q, v, one, other)
        if after is not None:
            d, ids = after[0][one], after[1][one]
            later = (exact > d) | (np.isnan(exact) & ~np.isnan(d)) | (((exact == d) | (np.isnan(exact) & np.isnan(d))) & (own[other] > ids))
            one, other, exact = one[later], other[later], exact[later]
    return least(len(q), one, own[other], exact, k)


def possible(how: Method, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(margin, low, high): the error of each query's distances, and the least and greatest they may be before it.

    low and high are one matrix where all is finite.
    """
    if how.near is None:
        d = np.concatenate([np.zeros((0, len(v))), *(some for _, some in every_pair(how, q, v))])
        margin, rough = np.zeros(len(q)), np.isnan(d)
    else:
        norms, squares = (q * q).sum(axis=1), (v * v).sum(axis=1)
        d = how.near(q, v, norms, squares)
        # a row of another order of magnitude is unsure, so it doesn't widen the margin of the others
        usual = 4 * np.median(squares) if len(squares) else 0.0
        margin = 1e-12 * max(1, q.shape[1] / 256) * (1 + np.where(np.isfinite(norms), norms, 0) + (usual if np.isfinite(usual) else 0))
        if np.isfinite(norms).all() and (squares <= usual).all() and np.isfinite(d.sum()):
            return margin, d, d
        rough = ~np.isfinite(d) | ~(np.isfinite(norms)[:, None] & (squares <= usual)[None, :])
    if not rough.any():
        return margin, d, d
    low, high = np.where(rough, how.least, d), np.where(rough, np.inf, d)
    if how.infinite_last:
        # what isn't finite may lie anywhere by the product alone, unless a part of it is infinite or no number
        low[:, ~np.isfinite(v).all(axis=1)] = np.inf
        low[~np.isfinite(q).all(axis=1)] = np.inf
    return margin, low, high


def usual_squares(x: np.ndarray) -> np.ndarray:
    return (x >= COARSE_SQUARES[0]) & (x <= COARSE_SQUARES[1])


def slack(n: int, of_queries: np.ndarray, of_rows: float) -> np.ndarray:
    """What a product of n factors in single precision may be off, by squared lengths: each term is rounded when it is made and when it is added."""
    return (n + 4) * 2.0**-23 * (1 + of_queries + of_rows)


def may_lie_within(how: Method, q: np.ndarray, v: np.ndarray, r: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, of rows, n): the pairs that may be no farther than each query's radius r. With ``count`` those that surely are
    come as numbers n of each query instead. Products in single precision tell most pairs, where lengths and radii are usual ones."""
    n, found = np.zeros(len(q), np.int64), []
    fair_q, fair_v = np.zeros(len(q), bool), np.zeros(len(v), bool)
    if how.factors is not None and len(q) and len(v):
        norms, squares = (q * q).sum(axis=1), (v * v).sum(axis=1)
        fair_q = usual_squares(norms) & (np.abs(r) <= COARSE_SQUARES[1])
        fair_v = usual_squares(squares) & (squares <= 4 * np.median(squares))
    for some_q, some_v in ((~fair_q, np.ones(len(v), bool)), (fair_q, ~fair_v)):
        at, of = np.flatnonzero(some_q), np.flatnonzero(some_v)
        if len(at) and len(of):
            margin, low, high = possible(how, q[at], v[of])
            sure = high <= (r[at] - margin)[:, None] if count else np.zeros(low.shape, bool)
            n[at] += sure.sum(axis=1)
            one, other = np.nonzero(~sure & ~(low > (r[at] + margin)[:, None]))
            found.append((at[one], of[other]))
    at, of = np.flatnonzero(fair_q), np.flatnonzero(fair_v)
    if len(at) and len(of):
        left, right = how.factors(q[at], True).astype(np.float32), np.ascontiguousarray(how.factors(v[of], False).astype(np.float32).T)
        margin = slack(left.shape[1], norms[at], squares[of].max())
        most, least_ = ((r[at] + x).astype(np.float32) for x in (margin, -margin))
        most, least_ = np.nextafter(most, np.float32(np.inf)), np.nextafter(least_, np.float32(-np.inf))
        for i in range(0, len(at), COARSE_QUERIES):
            some = slice(i, i + COARSE_QUERIES)
            d = left[some] @ right
            maybe = d <= most[some][:, None]
            if count:
                sure = d <= least_[some][:, None]
                n[at[some]] += np.count_nonzero(sure, axis=1)
                maybe ^= sure
            one, other = np.divmod(np.flatnonzero(maybe), len(of))
            found.append((at[some][one], of[other]))
    one, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return one, other, n


def exact_pairs(how: Method, q: np.ndarray, v: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs at these places of queries and rows."""
    step = max(1, FOLD_AT_ONCE // max(1, q.shape[1]))
    # where many are asked for, components lie together, as they are folded
    a, b = (np.asfortranarray(x) if len(one) > len(x) else x for x in (v, q))
    return np.concatenate([np.zeros(0), *(how.exact(side_by_side(a, other[at : at + step]), side_by_side(b, one[at : at + step]), False) for at in range(0, len(one), step))])


def side_by_side(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return x.T.take(at, axis=1).T if x.flags.f_contiguous else x[at]


class Coarse:
    """The queries of a task and their k least rows so far, for a first look in single precision.

    Once a query's k-th distance is known, a product in single precision and one comparison tell which rows may be nearer; these alone are
    folded. ``nearest_places`` does the rest: queries whose k-th isn't known yet, queries and rows of odd lengths, and
    where more than an eighth of the pairs are too near to tell.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, skip_self: bool, how: Method, after: tuple[np.ndarray, np.ndarray] | None):
        self.qids, self.q, self.k, self.skip_self, self.how, self.after = qids, np.asfortranarray(q), k, skip_self, how, after
        self.best = Best(len(qids), k)
        self.fair = np.zeros(len(qids), bool)
        if how.factors is not None and after is None:
            with np.errstate(all="ignore"):
                self.squares = (q * q).sum(axis=1)
                self.fair = usual_squares(self.squares)
                self.factors = how.factors(q, True).astype(np.float32)

    def add(self, own: np.ndarray, v: np.ndarray) -> None:
        ready = self.fair & np.isfinite(self.best.bound)
        if not ready.any():
            return self.plain(np.arange(len(self.qids)), own, v)
        with np.errstate(all="ignore"):
            squares = (v * v).sum(axis=1)
            fair = usual_squares(squares) & (squares <= 4 * np.median(squares))
        if not ready.all():
            self.plain(np.flatnonzero(~ready), own, v)
        if not fair.all():
            self.plain(np.flatnonzero(ready), own[~fair], v[~fair])
            own, v, squares = own[fair], v[fair], squares[fair]
        if len(own):
            self.look(np.flatnonzero(ready), own, v, squares)

    def plain(self, at: np.ndarray, own: np.ndarray, v: np.ndarray) -> None:
        """Rows for the queries at these places, in double precision."""
        every = len(at) == len(self.qids)
        some = (lambda x: x) if every else (lambda x: x[at])
        qids, q, after = some(self.qids), some(self.q), tuple(some(x) for x in self.after) if self.after else None
        step = max(64, PLAIN_PAIRS // max(1, len(at)))
        for i in range(0, len(own), step):
            one, ids, d = nearest_places(qids, q, own[i : i + step], v[i : i + step], self.k, self.skip_self, some(self.best.bound), self.how, after)
            self.best.add((at[one], ids, d))

    def look(self, at: np.ndarray, own: np.ndarray, v: np.ndarray, squares: np.ndarray) -> None:
        rows = np.ascontiguousarray(self.how.factors(v, False).astype(np.float32).T)
        every = len(at) == len(self.qids)
        near = np.empty((min(len(at), COARSE_QUERIES), len(own)), np.float32)
        inside = np.empty(near.shape, bool)
        bound, last = self.best.bound, self.best.last
        with np.errstate(over="ignore"):
            limit = np.nextafter((bound + slack(self.factors.shape[1], self.squares, squares.max())).astype(np.float32), np.float32(np.inf))
        found = []
        for i in range(0, len(at), COARSE_QUERIES):
            here = at[i : i + COARSE_QUERIES]
            some = slice(i, i + COARSE_QUERIES) if every else here
            d, yes = near[: len(here)], inside[: len(here)]
            np.matmul(self.factors[some], rows, out=d)
            np.less_equal(d, limit[some][:, None], out=yes)
            flat = np.flatnonzero(yes)
            if len(flat) > max(4 * self.k * len(here), yes.size // 8):
                self.plain(here, own, v)
            elif len(flat):
                one, other = np.divmod(flat, len(own))
                found.append((here[one], other))
        if not found:
            return
        one, other = (np.concatenate(x) for x in zip(*found))
        if self.skip_self:
            fair = self.qids[one] != own[other]
            one, other = one[fair], other[fair]
        d, ids = exact_pairs(self.how, self.q, v, one, other), own[other]
        fair = (d < bound[one]) | ((d == bound[one]) & (ids < last[one]))
        self.best.add((one[fair], ids[fair], d[fair]))


def nearest_pairs(qids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, skip_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``nearest_places``, with the queries' ids."""
    one, ids, d = nearest_places(qids, q, own, v, k, skip_self)
    return qids[one], ids, d


def least(n: int, one: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (place of one of n queries, row id, d) the k least of each query in order, ties to the smaller id."""
    order = np.argsort(d)
    ahead = d[order]
    if len(d) and (np.isnan(ahead[-1]) or (ahead[1:] == ahead[:-1]).any()):
        order = np.lexsort((ids, d))
    order = order[np.argsort(one[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]  # 16 bits are sorted by counting
    one, ids, d = one[order], ids[order], d[order]
    kept = np.arange(len(one)) - np.searchsorted(one, np.arange(n))[one] < k
    return one[kept], ids[kept], d[kept]


class Best:
    """The k least rows of each query among those that a task has seen."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: The k-th distance of each query so far.
        self.bound = np.full(n, np.inf)
        #: The id there.
        self.last = np.zeros(n, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Takes pairs in. They wait until a quarter of what is held came together, so batches cost no sort each."""
        if not len(found[0]):
            return
        self.waiting.append(found)
        if 4 * sum(len(x[0]) for x in self.waiting) >= len(self.held[0]):
            self.merge()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        return self.held

    def merge(self) -> None:
        if not self.waiting:
            return
        self.held = least(self.n, *(np.concatenate(x) for x in zip(self.held, *self.waiting)), self.k)
        self.waiting = []
        one, ids, d = self.held
        ends = np.searchsorted(one, np.arange(self.n), "right")
        full = np.flatnonzero(np.bincount(one, minlength=self.n) == self.k)
        self.bound[full] = np.where(np.isnan(d[ends[full] - 1]), np.inf, d[ends[full] - 1])
        self.last[full] = ids[ends[full] - 1]


def by_length(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) for each length of the vectors; those that are null or have a null component are left out."""
    lengths, values = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), vectors.flatten()
    starts = np.cumsum(lengths) - lengths
    whole = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        whole = nulls[starts + lengths] == nulls[starts]
    flat = values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[whole]):
        at = np.flatnonzero(whole & (lengths == n))
        yield int(n), ids[at], flat[starts[at][:, None] + np.arange(n)[None, :]]


def knn_by_matrix(base: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, skip_self: bool = False) -> DataFrame:
    """As ``knn`` with squared distances, by matrix products over Arrow batches.

    A batch's product chooses the rows that may be among the k nearest: all up to the k-th
    distance and a margin for rounding, ties included. Their distances are then folded exactly and
    each task keeps k rows per query, so what is shuffled is tasks x queries x k rows whatever
    the size of the base. Left out are rows and queries without a vector or with a null component, and pairs
    of unequal length. A distance that is no number counts as the greatest. No queries, no rows.
    ``skip_self`` leaves out the row with a query's own id.
    """
    if k < 1:
        raise ValueError("k must be positive")
    found = matrix_pairs(base, queries, k, block, skip_self)
    return top_k(found.drop("by"), k).select("qid", "rank", "id", "d")


def knn_by_group(base: DataFrame, queries: DataFrame, k: int, by: str, block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, by, place, id, d): the k nearest rows of each group, such as a shard, to each query; all groups in one scan.

    ``by`` is a column of whole numbers of the base. Each task keeps k rows per query and group.
    """
    if k < 1:
        raise ValueError("k must be positive")
    found = matrix_pairs(base, queries, k, block, by=by)
    place = F.row_number().over(W.partitionBy("qid", "by").orderBy("d", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("qid", F.col("by").alias(by), "place", "id", "d")


def matrix_pairs(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    block: int = QUERY_BLOCK,
    skip_self: bool = False,
    by: str | None = None,
    of: str | None = None,
    how: str | Method = "l2",
    after: tuple[str, str] | None = None,
) -> DataFrame:
    """(qid, by, id, d): of the rows of each task and each group of ``by`` in it the k nearest to each query.

    With ``of``, a column of the queries, a query meets the rows of its own group alone. ``after`` names columns of the queries, see
    ``nearest_places``. A task keeps what it found from batch to batch, and rows that are farther than a query's k-th are not folded, so it
    returns queries x groups x k rows at most, however many it reads.
    """
    parts, schema = [], "qid long, by long, id long, d double"
    block = min(block, max(256, HELD_ROWS // k))
    method = how if isinstance(how, Method) else METHODS[how]
    group = F.col(by).cast("long") if by else F.lit(0).cast("long")
    rows_with = base.select(F.col("id").cast("long").alias("id"), "v", group.alias("by")).where("v IS NOT NULL AND id IS NOT NULL AND by IS NOT NULL")
    asked = [F.col("qid").cast("long"), doubles(F.col("q")).alias("q"), (F.col(of).cast("long") if of else F.lit(0).cast("long")).alias("__of")]
    asked += [F.col(after[0]).cast("double").alias("__d"), F.col(after[1]).cast("long").alias("__id")] if after else []
    blocks = query_blocks(queries, block)
    if len(blocks) > 1:  # rows are read once for each block, so they are dealt evenly, however the table is cut
        rows_with = rows_with.repartition(max(2, base.sparkSession.sparkContext.defaultParallelism))
    rows_with = rows_with.select("id", doubles(F.col("v")).alias("v"), "by")
    for some in blocks:
        rows = some.select(*asked).where("qid IS NOT NULL AND q IS NOT NULL AND __of IS NOT NULL" + (" AND __d IS NOT NULL AND __id IS NOT NULL" if after else "")).toArrow()  # at most about a block
        if not rows.num_rows:
            continue
        numbers = [rows.column(i).to_numpy() for i in (0, 3, 4)[: 3 if after else 1]]
        groups_of = rows.column(2).to_numpy()
        asking: dict[tuple[int, int | None], tuple] = {}
        for n, place, q in by_length(np.arange(rows.num_rows), rows.column(1).combine_chunks()):
            for g in np.unique(groups_of[place]) if of else [None]:
                own = np.ones(len(place), bool) if g is None else groups_of[place] == g
                asking[n, None if g is None else int(g)] = q[own], *(x[place[own]] for x in numbers)
        held = base.sparkSession.sparkContext.broadcast(asking)
        step = max(64, min(2048, PLAIN_PAIRS // max([1, *(len(x[0]) for x in asking.values())])))

        def nearest(batches: Iterator[pa.RecordBatch], held=held, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], Coarse] = {}
            seen = 0
            for whole in batches:
                at = 0
                while at < whole.num_rows:
                    batch = whole.slice(at, max(step, min(seen, COARSE_ROWS)))
                    at, seen = at + batch.num_rows, seen + batch.num_rows
                    groups = batch.column(2).to_numpy()
                    for n, place, v in by_length(np.arange(batch.num_rows), batch.column(1)):
                        ids, group = batch.column(0).to_numpy()[place], groups[place]
                        for g in np.unique(group):
                            mine = held.value.get((n, int(g) if of else None))
                            if mine is None:
                                continue
                            q, qids, *last = mine
                            if (n, int(g)) not in best:
                                best[n, int(g)] = Coarse(qids, q, k, skip_self, method, tuple(last) or None)
                            here = group == g
                            best[n, int(g)].add(ids[here], v[here])
            for (n, g), so_far in best.items():
                one, ids, d = so_far.best.rows()
                for at in range(0, len(one), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    columns = held.value[n, g if of else None][1][one[part]], np.full(len(one[part]), g, np.int64), ids[part], d[part]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["qid", "by", "id", "d"])

        parts.append(rows_with.mapInArrow(nearest, schema))
    return reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], schema)
