"""Graph search by rounds, insertion and the scan of several indices against plain loops."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearlake.operators import frontier, graph, multiscan
from nearlake.operators.knn import knn
from nearlake.operators.measures import recall
from nearlake.operators.tables import settled
from nearlake.plans.inputs import base, stated_queries

DATA = "/root/testdata/sf0.001"


def fold(a, b):
    out = 0.0
    for x, y in zip(a, b):
        out += (x - y) * (x - y)
    return out


@pytest.fixture(scope="module")
def world(spark):
    """Rows, queries, edges and seeds as tables and as dicts."""
    rows, queries = settled(base(spark, DATA)), settled(stated_queries(spark, DATA))
    edges = settled(graph.both_ways(graph.pruned(graph.knn_graph(rows, 12), rows, 6)))
    seeds = queries.select("qid", F.explode(F.array(F.lit(1), F.lit(77), F.lit(200)).cast("array<long>")).alias("id"))
    v = {r.id: [float(x) for x in r.v] for r in rows.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    return rows, queries, edges, seeds, v, near


def plain_search(v, near, q, seeds, width, beam, max_check=None, scored=None):
    """Best first: the ``beam`` nearest that aren't done, until the ``width`` nearest are."""
    scored = {x: [fold(v[x], q), False] for x in seeds} if scored is None else scored
    while True:
        order = sorted(scored, key=lambda x: (scored[x][0], x))
        if all(scored[x][1] for x in order[:width]) or (max_check and len(scored) >= max_check):
            return scored
        for x in [x for x in order if not scored[x][1]][:beam]:
            scored[x][1] = True
            for y in near.get(x, ()):
                if y not in scored:
                    scored[y] = [fold(v[y], q), False]


def as_dicts(state):
    return {r.qid: {x.id: [x.d, x.done] for x in r.scored} for r in state.collect()}


def test_search_equals_a_best_first_loop(spark, world):
    rows, queries, edges, seeds, v, near = world
    table = settled(frontier.neighbours(edges))
    for width, beam, most in ((20, 4, None), (12, 1, 60)):
        got = as_dicts(frontier.deepen(frontier.start(rows, queries, seeds), rows, table, width, beam, most))
        want = {qid: plain_search(v, near, v[qid], (1, 77, 200), width, beam, most) for qid in got}
        assert len(got) == queries.count() and got == want


def test_a_search_goes_on_from_a_saved_state(spark, world, tmp_path):
    rows, queries, edges, seeds, *_ = world
    near = settled(frontier.neighbours(edges))
    first = frontier.start(rows, queries, seeds)
    frontier.deepen(first, rows, near, 8, 3).write.parquet(str(tmp_path / "state"))
    saved = spark.read.parquet(str(tmp_path / "state"))
    later, whole = as_dicts(frontier.deepen(saved, rows, near, 24, 3)), as_dicts(frontier.deepen(first, rows, near, 24, 3))
    assert later == whole
    # every pair was scored once: what the first call scored is a part of the second's, and no id is there twice
    before = as_dicts(saved)
    assert all(set(before[q]) <= set(later[q]) for q in later)
    assert all(len(r.scored) == len(later[r.qid]) for r in frontier.deepen(saved, rows, near, 24, 3).collect())


def test_searches_without_seeds_rows_or_vectors(spark, world):
    rows, queries, edges, seeds, *_ = world
    none = seeds.limit(0)
    assert frontier.frontier_search(edges, rows, queries, none, 3, 6).collect() == []
    assert frontier.frontier_search(edges, rows, queries.limit(0), seeds, 3, 6).collect() == []
    assert frontier.frontier_search(edges.limit(0), rows, queries, seeds, 3, 6).count() == 3 * queries.count()
    odd = spark.createDataFrame([(5, None), (6, [0.0] * 64), (None, [1.0] * 64)], "qid long, q array<double>")
    found = frontier.frontier_search(edges, rows, odd, spark.createDataFrame([(5, 1), (6, 1), (6, 1), (6, 10**9)], "qid long, id long"), 3, 6)
    assert {r.qid for r in found.collect()} == {6} and found.count() == 3
    with pytest.raises(ValueError):
        frontier.frontier_search(edges, rows, queries, seeds, 7, 6)


# --- insertion ------------------------------------------------------------------------------


def plain_prune(v, candidates, degree, alpha=1.2):
    kept = []
    for d, x in sorted(candidates):
        if len(kept) < degree and all(alpha * fold(v[n], v[x]) >= d for _, n in kept):
            kept.append((d, x))
    return kept


def plain_insert(v, near, new, seeds, degree, width, beam):
    """All of a batch search the graph before it; reverse edges; nodes beyond the degree pruned again."""
    fixed = {x: set(y for _, y in ys) for x, ys in near.items()}
    forward = {}
    for x in new:
        scored = plain_search(v, fixed, v[x], seeds, width, beam)
        best = sorted((d, y) for y, (d, _) in scored.items())[:width]
        forward[x] = plain_prune(v, [(d, y) for d, y in best if y != x], degree)
    return plain_link(v, near, forward, degree, width)


def plain_link(v, near, forward, degree, width):
    back = {}
    for x, ys in forward.items():
        for d, y in ys:
            back.setdefault(y, []).append((d, x))
    out = {x: set(ys) for x, ys in near.items()}
    for x, ys in forward.items():
        out.setdefault(x, set()).update(ys)
    for y, xs in back.items():
        out.setdefault(y, set()).update(heapq.nsmallest(width, xs))
    return {x: set(plain_prune(v, ys, degree)) if len(ys) > degree else ys for x, ys in out.items()}


def test_insertion_equals_a_sequential_one_and_the_graph_is_searchable(spark):
    """500 rows: a graph of the first 150, the others in two batches."""
    rows = settled(base(spark, "/root/testdata/sf0.01").select("id", "v"))
    v = {r.id: [float(x) for x in r.v] for r in rows.collect()}
    degree, width, beam = 10, 24, 6
    seeds = [0, 50, 100]
    seeds_of = lambda inside, new: new.select("qid", F.explode(F.array(*map(F.lit, seeds)).cast("array<long>")).alias("id"))
    batch = F.when(F.col("id") < 300, 0).otherwise(1)
    grown = frontier.grow_graph(rows, F.col("id") < 150, batch, 2, degree, width, beam=beam, seeds_of=seeds_of)

    inside = [x for x in v if x < 150]
    nearest = {x: sorted((fold(v[y], v[x]), y) for y in inside if y != x)[:width] for x in inside}
    near = plain_link(v, {}, {x: plain_prune(v, ys, degree) for x, ys in nearest.items()}, degree, width)
    for low, high in ((150, 300), (300, 500)):
        near = plain_insert(v, near, [x for x in v if low <= x < high], seeds, degree, width, beam)

    got = {(r.src, r.dst) for r in grown.collect()}
    assert got == {(x, y) for x, ys in near.items() for _, y in ys}
    assert grown.groupBy("src").count().agg(F.max("count")).first()[0] <= degree
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    starts = queries.select("qid", F.explode(F.array(*map(F.lit, seeds)).cast("array<long>")).alias("id"))
    found = frontier.frontier_search(grown, rows, queries, starts, 10, 60, 8)
    assert recall(knn(rows, queries, 10), found, 10).first()["recall"] >= 90


# --- several indices ------------------------------------------------------------------------

COLUMNS = [("v1", "q1"), ("v2", "q2"), ("v3", "q3")]


def halves(spark, k=None):
    cut = lambda c, i: F.slice(F.col(c).cast("array<double>"), 20 * i + 1, 20)
    rows = base(spark, DATA).select("id", *(cut("v", i).alias(f"v{i + 1}") for i in range(3)))
    queries = stated_queries(spark, DATA).select("qid", *(cut("q", i).alias(f"q{i + 1}") for i in range(3)))
    return settled(rows), settled(queries)


def plain_scan(rows, q, weights, k, drops, limit):
    lists = [sorted((fold(r[i], q[i]), x) for x, r in rows.items()) for i in range(len(q))]
    best, seen, row, last = [], set(), 0, 0
    for turn in range(len(rows)):
        for ranked in lists:
            x = ranked[turn][1]
            if x in seen:
                continue
            seen.add(x)
            last = turn + 1
            d = 0.0
            for w, a, b in zip(weights, rows[x], q):
                d = d + w * fold(a, b)
            if len(best) == k and best[-1][0] <= d:
                row += 1
            else:
                row, best = 0, sorted([*best, (d, x)])[:k]
        if row >= drops or len(seen) >= limit:
            break
    return best, last


@pytest.mark.parametrize("drops,limit,page", [(6, 10**6, 4), (10**6, 40, 16), (10**6, 10**6, 64), (3, 25, 2)])
def test_scan_of_indices_ends_where_a_plain_one_does(spark, drops, limit, page):
    rows, queries = halves(spark)
    weights = (0.5, 0.3, 0.2)
    score = lambda d: sum((F.lit(w) * x for w, x in zip(weights, d)), F.lit(0.0))
    got = {}
    for r in multiscan.multi_index_scan(rows, queries, COLUMNS, score, 5, drops, limit, page).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, ([], r.rounds))[0].append((r.d, r.id))
    have = {r.id: [r.v1, r.v2, r.v3] for r in rows.collect()}
    for r in queries.collect():
        assert got[r.qid] == plain_scan(have, [r.q1, r.q2, r.q3], weights, 5, drops, limit)
    assert len(got) == queries.count()


def test_queries_that_walk_in_blocks_end_as_all_at_once(spark, monkeypatch):
    random = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in random.normal(size=4)]) for i in range(60)], "id long, v array<float>").cache()
    queries = rows.where("id < 8").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    edges = spark.createDataFrame([(i, (i * 7 + j) % 60) for i in range(60) for j in (1, 9, 31)], "src long, dst long").where("src <> dst")
    near = frontier.settled(frontier.neighbours(edges))
    first = frontier.settled(frontier.start(rows, queries, queries.select("qid", F.lit(30).cast("long").alias("id"))))
    whole = frontier.deepen(first, rows, near, 6, 2).orderBy("qid").collect()
    monkeypatch.setattr(frontier, "WALK_BLOCK", 3)
    assert frontier.deepen(first, rows, near, 6, 2).orderBy("qid").collect() == whole and len(whole) == 8


def test_a_row_meets_all_its_queries_in_one_row(spark):
    """What a round sends to be scored has a row's vector once, and what comes back has a query's scores together."""
    asked = frontier._asked(spark.createDataFrame([(7, [1.0, 2.0]), (5, [0.5, 0.25]), (9, [1.0, 1.0, 1.0])], "qid long, q array<double>"))
    asking = spark.createDataFrame([(1, [5, 7, 5], [0.0, 3.0]), (2, [7, 9, 11], [1.0, 0.1]), (3, [9, 5], [1.0, None]), (4, [5], None)], "id long, qids array<long>, v array<float>")
    got = {}
    for r in frontier._scored(asking.coalesce(1), asked).collect():
        assert r.qid not in got and set(r.done) == {0}
        got[r.qid] = dict(zip(np.frombuffer(r.id, np.int64).tolist(), np.frombuffer(r.d).tolist()))
    assert got == {5: {1: fold([0.0, 3.0], [0.5, 0.25])}, 7: {1: fold([0.0, 3.0], [1.0, 2.0]), 2: fold([1.0, float(np.float32(0.1))], [1.0, 2.0])}}


def test_order_of_what_ties():
    random = np.random.default_rng(2)
    of, ids, done = np.sort(random.integers(0, 9, 4000)), random.integers(0, 300, 4000), random.random(4000) < 0.5
    d = np.where(ids % 11 == 0, np.nan, np.where(ids % 7 == 0, np.inf, ids % 50 / 7))
    got, want = frontier._in_order(9, of, d, ids, done), np.lexsort((~done, ids, d, of))
    assert all(np.array_equal(x[got], x[want], equal_nan=x.dtype == float) for x in (of, d, ids, done))


def test_queries_that_are_over_lie_in_files_of_their_own(spark):
    table = settled(spark.range(40).selectExpr("id", "id % 4 = 0 AS open").repartition(3), "open")
    over = table.where("NOT open")
    assert over.count() == 30 and table.where("open").count() == 10 and table.columns == ["id", "open"]
    scan = next(x for x in over._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "open" in scan.split("PartitionFilters: [")[1].split("]")[0]
