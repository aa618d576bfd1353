"""Measures of search results: recall and its relatives, ranks, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.operators.tables import settled


def truth_with_ties(truth: DataFrame, k: int) -> DataFrame:
    """The first k truth rows (qid, rank, id, d) of each query and all that tie with the k-th."""
    return truth.withColumn("tie", F.rank().over(W.partitionBy("qid").orderBy("d"))).where(F.col("tie") <= k).drop("tie")


def recall_by_query(truth: DataFrame, results: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """(qid, hits, recall): hits among the first k results over k; queries without results get 0."""
    real = truth_with_ties(truth, k) if ties else truth.where(F.col("rank") <= k)
    hit = results.where(F.col("rank") <= k).select("qid", "id").distinct().withColumn("hit", F.lit(1))
    counted = real.select("qid", "id").join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"))
    return counted.withColumn("recall", F.least(F.col("hits"), F.lit(k)) / F.lit(float(k)))


def recall(truth: DataFrame, results: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """One row: hits of all queries and recall in percent."""
    by = recall_by_query(truth, results, k, ties)
    return by.agg(F.sum(F.least("hits", F.lit(k))).alias("hits"), F.count("*").alias("n_queries")).withColumn(
        "recall", F.round(100.0 * F.col("hits") / (F.col("n_queries") * k), 6)
    )


def range_recall(truth: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean over queries of the percentage of truth found; a query without truth counts as 100."""
    found = truth.join(results.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    by = found.groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return _mean_percent(by, queries)


def range_recall_of_counts(truth: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """As ``range_recall``, from the numbers (qid, n) of rows that each query should find and of those among them that it found."""
    by = truth.join(hits.select("qid", F.col("n").alias("hits")), "qid", "left").select("qid", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    return _mean_percent(by, queries)


def _mean_percent(by: DataFrame, queries: DataFrame) -> DataFrame:
    each = queries.select("qid").join(by, "qid", "left").select(F.coalesce(100.0 * F.col("hits") / F.col("n"), F.lit(100.0)).alias("p"))
    return each.agg(F.round(F.avg("p"), 6).alias("recall"))


def reciprocal_rank(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Mean of 1 / position of the first result that is in the truth, 0 where none is."""
    best = results.join(truth.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("best"))
    each = truth.select("qid").distinct().join(best, "qid", "left").select(F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("r"))
    return each.agg(F.round(F.avg("r"), 9).alias("mrr"))


def recall_by_distance(truth: DataFrame, results: DataFrame, k: int, slack: float = 1e-3) -> DataFrame:
    """Mean and deviation over queries of the share of results no farther than the k-th truth and a slack."""
    limit = truth.where(F.col("rank") == k).select("qid", (F.col("d") + slack).alias("limit"))
    by = limit.join(results.where(F.col("rank") <= k), "qid", "left").groupBy("qid").agg(F.count_if(F.col("d") <= F.col("limit")).alias("hits"))
    share = F.col("hits") / F.lit(float(k))
    return by.agg(F.round(F.avg(share), 9).alias("mean"), F.round(F.stddev_pop(share), 9).alias("std"))


def recall_by_slot(truth: DataFrame, results: DataFrame, k: int, slack: float = 1e-6) -> DataFrame:
    """(qid, hits, recall): each of the first k results answers for one truth row at most.

    Truth rows are taken in order of their ids; each takes the first result left that has its id, or whose distance d differs from
    its own by less than slack * (d + slack). Recall is hits over the truth rows of the query; a query without results gets 0.
    """
    wanted = truth.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("id", "d"))).alias("truth"))
    slots = results.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "d"))).alias("slots"))

    def take(s: Column, t: Column) -> Column:
        fits = F.transform(s["left"], lambda x: F.coalesce((x["id"] == t["id"]) | (F.abs(x["d"] - t["d"]) < slack * (x["d"] + slack)), F.lit(False)))
        at = F.array_position(fits, F.lit(True)).cast("int")
        rest = F.concat(F.slice(s["left"], F.lit(1), at - 1), F.slice(s["left"], at + 1, F.size(s["left"])))
        return F.when(at > 0, F.struct((s["hits"] + 1).alias("hits"), rest.alias("left"))).otherwise(F.struct(s["hits"].alias("hits"), s["left"].alias("left")))

    begin = F.struct(F.lit(0).alias("hits"), F.coalesce("slots", F.expr("array()").cast("array<struct<rank: int, id: bigint, d: double>>")).alias("left"))
    hits = F.aggregate("truth", begin, take, lambda s: s["hits"])
    return wanted.join(slots, "qid", "left").select("qid", hits.alias("hits"), (hits / F.size("truth")).alias("recall"))


def nearest_rank(rows: DataFrame, value: str, fractions: list[float], by: str | None = None) -> DataFrame:
    """Percentiles that are values of the data: the one at place floor(p * n) in order, from 0, of all rows or of each group.

    Values are counted before they are ordered, as many rows may share one; places of the counted ones come from sums over ranges
    of values, so neither the whole table nor a large group is one task's work. Nulls are left out.
    """
    from nearlake.operators.partition import in_ranges

    group = F.col(by) if by else F.lit(0)
    counted = settled(rows.where(F.col(value).isNotNull()).groupBy(F.struct(group.alias("g"), F.col(value).alias("x")).alias("key")).agg(F.count("*").alias("n")))
    ranged = in_ranges(counted, "key")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.sum("n").alias("m")).select("__part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))  # a row per range
    end = F.sum("n").over(W.partitionBy("__part").orderBy("key"))
    placed = ranged.withColumn("__end", end).join(starts, "__part").select("key.g", "key.x", "n", (F.col("start") + F.col("__end")).alias("end"))
    placed = settled(placed)
    groups = placed.groupBy("g").agg(F.sum("n").alias("total"), F.min(F.col("end") - F.col("n")).alias("first"))  # a row per group
    wanted = groups.select("g", F.explode(F.array(*(F.lit(float(p)) for p in fractions))).alias("p"), "total", "first").withColumn("at", F.col("first") + F.least(F.floor(F.col("p") * F.col("total")), F.col("total") - 1))
    found = placed.join(wanted.select("g", "p", "at"), "g").where((F.col("end") - F.col("n") <= F.col("at")) & (F.col("at") < F.col("end")))
    return found.select(*([F.col("g").alias(by)] if by else []), "p", F.col("x").alias("value"))


def new_maxima(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The rows whose y exceeds that of every row with a larger x, and of equal x with a larger y: a Pareto front.

    Rows are dealt to ranges of x; the greatest y of the ranges before one bounds it from below.
    """
    from nearlake.operators.partition import in_ranges

    ranged = in_ranges(rows.withColumn("__key", F.struct((-F.col(x)).alias("x"), (-F.col(y)).alias("y"))), "__key")
    before = W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    tops = ranged.groupBy(F.col("__part").alias("__of")).agg(F.max(y).alias("__top")).select("__of", F.max("__top").over(before).alias("__before"))  # a row per range
    within = F.max(y).over(W.partitionBy("__part").orderBy("__key").rowsBetween(W.unboundedPreceding, -1))
    best = F.greatest("__within", "__before")
    joined = ranged.withColumn("__within", within).join(tops, F.col("__part") == F.col("__of"))
    return joined.where(best.isNull() | (F.col(y) > best)).select(*rows.columns)


def share_of(rows: DataFrame, key: str, total: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / total, 6))
