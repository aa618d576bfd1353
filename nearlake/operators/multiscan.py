"""Search over several indices at once: sorted access to each in turn, random access for the rest of a score, early end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlake.functions.vectors import doubles, l2
from nearlake.operators.knn import knn, top_k
from nearlake.operators.tables import settled

#: best: the k best so far; drops: rows in a row that didn't get in; seen: rows met; round: the last that gave a new row.
FOLD = "struct<best: array<struct<d: double, id: long>>, drops: int, seen: int, round: int, over: boolean>"


def in_turn(rows: DataFrame, queries: DataFrame, columns: list[tuple[str, str]], depth: int) -> DataFrame:
    """(qid, round, turn, id): the rows that each index gives in its rounds 1 to ``depth``; an id counts where it comes first."""
    found = [knn(rows.select("id", F.col(v).alias("v")), queries.select("qid", F.col(q).alias("q")), depth).select("qid", F.col("rank").alias("round"), F.lit(i).alias("turn"), "id") for i, (v, q) in enumerate(columns)]
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    first = both.groupBy("qid", "id").agg(F.min(F.struct("round", "turn")).alias("at"))
    return first.select("qid", "at.round", "at.turn", "id")


def scored(met: DataFrame, rows: DataFrame, queries: DataFrame, columns: list[tuple[str, str]], score: Callable[[list[Column]], Column]) -> DataFrame:
    """Adds d: the score from the distances in all indices, looked up by id."""
    vs, qs = [v for v, _ in columns], [q for _, q in columns]
    joined = met.join(rows.select("id", *vs), "id").join(queries.select("qid", *qs), "qid")
    return joined.withColumn("d", score([l2(F.col(v), F.col(q)) for v, q in columns])).drop(*vs, *qs)


def folded_rounds(state: Column, met: Column, k: int, drops: int, limit: int, whole: Column) -> Column:
    """The state after the rows ``met``, an array of (round, turn, d, id) in that order, with which a round ends.

    A row goes among the k best unless k others are no worse; if not, it counts as a drop, and one that gets in sets
    the count back. The count and the number of rows seen are looked at when a round is over. ``whole`` tells
    whether the indices have no more rows, which ends the scan too.
    """
    stops = lambda s: (s["round"] > 0) & ((s["drops"] >= drops) | (s["seen"] >= limit))

    def take(s: Column, x: Column) -> Column:
        full = F.size(s["best"]) >= k
        out = full & (F.element_at(s["best"], F.lit(-1))["d"] <= x["d"])
        item = F.struct(x["d"].alias("d"), x["id"].alias("id"))
        best = F.when(out, s["best"]).otherwise(F.slice(F.array_sort(F.concat(s["best"], F.array(item))), 1, k))
        taken = F.struct(best.alias("best"), F.when(out, s["drops"] + 1).otherwise(0).alias("drops"), (s["seen"] + 1).alias("seen"), x["round"].alias("round"), F.lit(False).alias("over"))
        over = s["over"] | ((x["round"] > s["round"]) & stops(s))
        return F.when(over, s.withField("over", F.lit(True)).cast(FOLD)).otherwise(taken.cast(FOLD))

    return F.aggregate(met, state.cast(FOLD), take, lambda s: s.withField("over", s["over"] | stops(s) | whole).cast(FOLD))


def multi_index_scan(rows: DataFrame, queries: DataFrame, columns: list[tuple[str, str]], score: Callable[[list[Column]], Column], k: int, drops: int, limit: int, page: int = 16) -> DataFrame:
    """(qid, rank, id, d, rounds): the k best by score that a round-robin scan of the indices meets, and its last round with a new row.

    Each index, a pair of a column of the rows and one of the queries, gives its rows in order of their distance to the
    query, one a round. A row met for the first time is scored by its distances in all indices. A scan
    ends after a round in which ``drops`` rows in a row failed to get among the best k, or ``limit`` rows have been seen, or
    the rows are exhausted. ``limit`` also bounds what a query carries: at most ``limit`` + the number of indices rows.

    Sorted access is paged: all queries read ``page`` rounds, those that aren't over twice as many, and so on; only their
    state, k rows and three numbers, passes from page to page. Ties go to the smaller id.
    """
    if min(k, drops, limit, page) < 1 or not columns:
        raise ValueError("k, drops, limit and page must be positive, and there must be an index")
    asked = queries.select("qid", *(doubles(F.col(q)).alias(q) for _, q in columns))
    here = rows.select("id", *(doubles(F.col(v)).alias(v) for v, _ in columns))
    n = here.count()
    state = asked.select("qid", F.expr(f"cast(struct(array(), 0, 0, 0, false) as {FOLD})").alias("s"))
    depth, before, ended = min(page, max(n, 1)), 0, []
    while True:
        left = asked.join(state.where("NOT s.over").select("qid"), "qid", "left_semi")
        met = scored(in_turn(here, left, columns, depth).where(F.col("round") > before), here, left, columns, score)
        pages = met.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("round", "turn", "d", "id"))).alias("met"))
        folded = folded_rounds(F.col("s"), F.coalesce("met", F.array().cast("array<struct<round: int, turn: int, d: double, id: long>>")), k, drops, limit, F.lit(depth >= n))
        state = settled(state.where("NOT s.over").join(pages, "qid", "left").select("qid", folded.alias("s")))
        ended.append(state.where("s.over"))
        if depth >= n or state.where("NOT s.over").isEmpty():
            break
        before, depth = depth, min(2 * depth, n)
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    best = out.select("qid", F.col("s.round").alias("rounds"), F.posexplode("s.best").alias("at", "x"))
    return best.select("qid", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.d").alias("d"), "rounds")


def fixed_rounds(rows: DataFrame, queries: DataFrame, columns: list[tuple[str, str]], score: Callable[[list[Column]], Column], k: int, rounds: int) -> DataFrame:
    """(qid, rank, id, d): the k best by score among the rows that the indices give in so many rounds."""
    met = scored(in_turn(rows, queries, columns, rounds), rows, queries, columns, score)
    return top_k(met, k).select("qid", "rank", "id", "d")
