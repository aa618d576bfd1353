"""Pairs scored in blocks: the numbers of the expressions, odd vectors included, and no join that makes a row of vectors per pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearlake.functions import vectors as V
from nearlake.operators import knn as K
from nearlake.operators import measures as M
from nearlake.operators import pairs as P
from nearlake.plans import QUERIES

DATA = "/root/testdata/sf0.001"
INF, NAN = math.inf, math.nan
ODD = [(1, [0.0, 0.0, 0.0], 0), (2, [1e300, -1e300, 1.0], 1), (3, [NAN, 1.0, 2.0], 1), (4, [INF, 1.0, 2.0], 0), (5, None, 1), (6, [1.0, None, 2.0], 0), (7, [1.0, 2.0], 1), (8, [1e-200, 0.0, 1e-180], 0), (8, [3.0, 2.0, 1.0], None), (None, [1.0, 2.0, 2.0], 0)]


@pytest.fixture(scope="module")
def odd(spark):
    random = np.random.default_rng(3)
    rows = ODD + [(100 + i, [float(x) for x in np.round(random.normal(size=3), 1)], int(i % 3)) for i in range(150)]
    rows += [(300 + i, [0.5, 0.5, 0.5], 2) for i in range(20)]
    base = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3).cache()
    return base, base.where("id % 2 = 0 OR id < 9").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("qlabel"))


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


def no_pairwise_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["l2", "inner_product", "fast_l2", "euclidean"])
def test_all_pairs_by_expressions(odd, name):
    base, queries = odd
    got = K.all_pairs(base, queries, P.METHODS[name], block=40)
    want = K.paired(base, queries).select("qid", "id", V.metric(name)(F.col("v"), F.col("q")).alias("d"))
    assert plain(got.collect()) == plain(want.collect())


@pytest.mark.parametrize("name", ["distance_cosine", "distance_cosine_of_units", "distance_fast_l2", "distance_euclidean", "similarity_from_distance", "distance_inner_product", "distance_l2"])
def test_distances_make_no_pairs_of_vectors(spark, name):
    assert no_pairwise_join(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["distance_cosine", "distance_cosine_of_units", "distance_fast_l2", "distance_euclidean", "distance_inner_product", "distance_l2", "symmetric_distance"])
def test_rows_are_dealt_once_as_they_are_stored(spark, monkeypatch, name):
    """Whatever the number of blocks of queries: beside its rows a query puts its input on disk once, not doubled."""
    monkeypatch.setattr(K.all_pairs, "__defaults__", ("double", 9))
    df = QUERIES[name](spark, DATA)
    want = df.count()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2 and plan.count("Exchange RoundRobin") - plan.count("ReusedExchange") == 1
    dealt = plan.split("Exchange RoundRobin")[1].split("MapInArrow")[0]
    assert "double" not in dealt and want == 500 * 25


def test_rounding_as_in_sql():
    x = np.array([0.5, -0.5, 1.4999999, -0.2, 2.5, INF, -INF, NAN, 0.49999999999999994])
    assert [repr(float(r)) for r in P.rounded(x, 0)] == ["1.0", "-1.0", "1.0", "-0.0", "3.0", "inf", "-inf", "nan", "0.0"]


def same_rows(got, want):
    assert plain(got.collect()) == plain(want.collect())


def by_expressions(base, queries, k, distance, condition=None):
    pairs = K.scored_pairs(base, queries, distance, condition).select("qid", "id", "d").where("d IS NOT NULL AND id IS NOT NULL AND qid IS NOT NULL")
    return pairs


@pytest.mark.parametrize("name", ["inner_product", "cosine", "fast_l2", "euclidean", "l2"])
def test_nearest_by_expressions(odd, name):
    base, queries = odd
    one = queries.where("qid IS NOT NULL").dropDuplicates(["qid"])
    whole = base.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    if name == "cosine":  # the expression calls a pair of unequal lengths 1
        whole, one = whole.where("size(v) = 3"), one.where("size(q) = 3 AND NOT exists(q, x -> x IS NULL)")
    got = K.knn(whole, one, 12, name, block=40)
    assert no_pairwise_join(got)
    want = K.top_k(by_expressions(whole, one, 12, name), 12).select("qid", "rank", "id", "d")
    same_rows(got.select("qid", "rank", "d"), want.select("qid", "rank", "d"))


def test_own_group_and_not_self(odd):
    base, queries = odd
    one = queries.where("qid IS NOT NULL").dropDuplicates(["qid"])
    got = K.knn(base, one, 4, skip_self=True, same=("label", "qlabel"), block=40)
    assert no_pairwise_join(got)
    pairs = by_expressions(base, one, 4, "l2", (F.col("label") == F.col("qlabel")) & (F.col("id") != F.col("qid")))
    same_rows(got, K.top_k(pairs, 4).select("qid", "rank", "id", "d"))


def test_what_comes_after_and_counts(odd):
    base, queries = odd
    one = queries.where("qid IS NOT NULL").dropDuplicates(["qid"])
    whole = K.knn(base, one, 40)
    last = whole.where("rank = 9").select("qid", F.col("d").alias("ld"), F.col("id").alias("lid"))
    got = K.next_nearest(base, one, last, 7, block=40)
    assert no_pairwise_join(got)
    same_rows(got, whole.where("rank > 9 AND rank <= 16").withColumn("rank", F.col("rank") - 9).select("qid", "rank", "id", "d"))
    limits = one.withColumn("r", F.when(F.col("qid") % 4 == 0, 0.0).otherwise(F.col("qid") / 100.0))
    pairs = K.scored_pairs(base, limits).where("d <= r").select("qid", "id", "d")
    same_rows(K.within(base, limits, F.col("r"), block=40), pairs)
    same_rows(K.counts_within(base, limits, F.col("r"), block=40), pairs.groupBy("qid").agg(F.count("*").alias("n")))


@pytest.mark.parametrize("name", ["knn_excluding_self", "knn_with_query_label", "knn_with_universal_label", "knn_inner_product", "knn_cosine", "multi_index_weighted_sum", "iterator_next_batch", "range_search", "range_search_per_query", "range_radius", "hamming_of_signs", "symmetric_distance", "tree_search", "segment_tree_search"])
def test_queries_make_no_pairs_of_vectors(spark, name):
    assert no_pairwise_join(QUERIES[name](spark, DATA))


def test_hamming_of_other_numbers(spark):
    base = spark.createDataFrame([(i, [float((i * j) % 3) for j in range(5)]) for i in range(9)], "id long, v array<double>")
    queries = base.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    want = K.paired(base, queries).select("qid", "id", V.hamming(F.col("v"), F.col("q")).alias("d"))
    same_rows(K.all_pairs(base, queries, P.METHODS["hamming"], "int"), want)


def test_a_pair_that_shares_labels_counts_once(spark):
    from nearlake.operators.mutate import sharing_labels

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", "c"]), (3, ["c", None]), (4, []), (5, ["a", "a"])], "id long, labels array<string>")
    got = sharing_labels(rows.select(F.col("id").alias("qid"), "labels"), rows)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 3), (2, 5), (3, 2), (3, 3), (5, 1), (5, 2), (5, 5)}
    assert sorted((r.qid, r.id) for r in got.collect()) == sorted(want)


def on_vectors(spark, tmp_path, name, vectors):
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb

    from nearlake.plans import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    return sorted(map(repr, (tuple(r) for r in got.collect()))), sorted(map(repr, con.execute(ORACLES[name]).fetchall()))


def test_a_float_next_to_the_bound(spark, tmp_path):
    got, want = on_vectors(spark, tmp_path, "jaccard_of_large_coordinates", [[0.15, 0.3] + [0.0] * 62, [0.0, 0.3] + [0.0] * 61 + [0.2]])
    assert got == want


def test_places_of_odd_vectors_as_in_sql(spark, tmp_path):
    long, short = [0.0] * 66 + [0.5], [0.5, 0.1, 0.2]
    vectors = [[NAN, 0.2] + [0.0] * 62, None, short, long, [None, 0.5, NAN], [0.0] * 64, [0.5] * 70] + [[0.2 * (i % 3 == j % 3) for j in range(64)] for i in range(13)]
    vectors = [*vectors, None, *vectors[1:], short, *vectors[1:], long]
    got, want = on_vectors(spark, tmp_path, "jaccard_of_large_coordinates", vectors)
    assert got == want and len({r.split(",")[0] for r in got}) == 4


def test_places_make_no_pairs_of_arrays(spark):
    assert no_pairwise_join(QUERIES["jaccard_of_large_coordinates"](spark, DATA))


@pytest.mark.parametrize("name", ["augment_for_inner_product", "normalize"])
def test_small_negative_components_round_as_in_sql(spark, tmp_path, name):
    got, want = on_vectors(spark, tmp_path, name, [[-1e-12, 0.6, 0.8], [1e-12, -0.00390625, 0.5]])
    assert got == want and any("-0.0," in r for r in got)


def test_what_a_task_holds_is_bounded_by_k(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(K, "query_blocks", lambda queries, block: seen.append(block) or [queries])
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<double>")
    K.knn(rows, rows.select(F.col("id").alias("qid"), F.col("v").alias("q")), 1024)
    assert seen and seen[0] * 1024 <= K.HELD_ROWS


def test_merging_late_holds_the_same():
    random = np.random.default_rng(1)
    best, every = K.Best(5, 4), []
    for _ in range(60):
        n = int(random.integers(0, 12))
        found = random.integers(0, 5, n), random.integers(0, 50, n), random.integers(0, 9, n) / 2.0
        every.append(found)
        best.add(found)
    want = K.least(5, *(np.concatenate(x) for x in zip(*every)), 4)
    assert all((a == b).all() for a, b in zip(best.rows(), want))


def test_bit_codes_leave_a_task_as_k_rows_a_query(spark):
    from nearlake.operators import quantize as Q

    random = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in random.normal(size=16)]) for i in range(5000)]
    rows = spark.createDataFrame(vectors, "id long, v array<double>").coalesce(1)
    centers = spark.createDataFrame([(0, [0.0] * 16)], "cid long, c array<double>")
    queries = rows.where("id < 3").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    coded = Q.rotated_bit_codes(rows, centers, 4).coalesce(1).cache()
    wide = {(r.qid, r.id): r.d for r in Q.bit_code_candidates(coded, queries, centers, 5000, 4).collect()}
    near = Q.bit_code_candidates(coded, queries, centers, 10, 4).collect()
    want = {(q, i) for q in range(3) for _, i in sorted((d, i) for (x, i), d in wide.items() if x == q)[:10]}
    assert len(wide) == 15000 and {(r.qid, r.id) for r in near} == want


@pytest.mark.parametrize("how", ["l2", "inner_product", "cosine"])
def test_the_first_look_in_single_precision_loses_no_row(how):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 12))
    v[100:180] = v[2]  # ties
    v[5], v[6, 3], v[9], v[11] = 0, np.nan, v[9] * 1e3, v[11] * 1e20
    q = np.concatenate([v[:40], v[2:3] + 1e-9])
    ids, qids = rng.permutation(3000), np.arange(41)
    looked = []
    task = K.Coarse(qids, q, 7, False, P.METHODS[how], None)
    task.look = lambda *args, plain=task.look: looked.append(1) or plain(*args)
    for at in range(0, 3000, 200):
        task.add(ids[at : at + 200], v[at : at + 200])
    expected = K.nearest_places(qids, q, ids, v, 7, how=P.METHODS[how])
    assert looked and all(np.array_equal(a, b, equal_nan=a.dtype == float) for a, b in zip(task.best.rows(), expected))
    exact = np.concatenate([d for _, d in P.every_pair(P.METHODS[how], q, v)])
    with np.errstate(all="ignore"):
        for r in (np.full(41, np.nanquantile(exact, 0.01)), np.where(qids == 3, np.nan, exact[:, 50])):
            wanted = (exact <= r[:, None]) | np.isnan(r)[:, None]
            for count in (False, True):
                one, other, n = K.may_lie_within(P.METHODS[how], q, v, r, count)
                inside = wanted[one, other]
                assert np.array_equal(n + np.bincount(one[inside], minlength=41), wanted.sum(axis=1))


def test_range_recall_of_counts_is_that_of_pairs(spark):
    truth = spark.createDataFrame([(q, i) for q in range(3) for i in range(q * 4)], "qid long, id long")
    found = truth.where("id % 3 <> 0")
    queries = spark.createDataFrame([(q,) for q in range(4)], "qid long")
    counts = [x.groupBy("qid").agg(F.count("*").alias("n")) for x in (truth, found)]
    assert M.range_recall_of_counts(*counts, queries).collect() == M.range_recall(truth, found, queries).collect()
