"""Queries without SQL against plain versions of them."""

from collections import defaultdict

import numpy as np
import pytest

from nearlake.operators.measures import recall
from nearlake.plans import QUERIES
from nearlake.plans.inputs import base

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.id: (np.array([float(x) for x in r.v]), r.label) for r in base(spark, DATA).collect()}


def square(a, b):
    return float(((a - b) ** 2).sum())


def occluded(vectors, candidates, degree, alpha=1.2):
    kept = []
    for d, x in sorted(candidates):
        if len(kept) < degree and all(alpha * square(vectors[n][0], vectors[x][0]) >= d for _, n in kept):
            kept.append((d, x))
    return [x for _, x in kept]


def test_pruned_graph(spark, vectors):
    want = set()
    for x, (v, _) in vectors.items():
        near = sorted((square(w, v), y) for y, (w, _) in vectors.items() if y != x)[:20]
        want |= {(x, y) for y in occluded(vectors, near, 8)}
    assert {(r.src, r.dst) for r in QUERIES["pruned_graph"](spark, DATA).collect()} == want


def test_stitched_graph(spark, vectors):
    by_label = defaultdict(list)
    for x, (_, label) in vectors.items():
        by_label[label].append(x)
    want = set()
    for label, members in by_label.items():
        for x in members if label is not None else ():
            near = sorted((square(vectors[y][0], vectors[x][0]), y) for y in members if y != x)[:15]
            want |= {(x, y) for y in occluded(vectors, near, 8)}
    assert {(r.src, r.dst) for r in QUERIES["stitched_graph"](spark, DATA).collect()} == want


def test_tree_search(spark, vectors):
    leaf = {r.id: r.node for r in QUERIES["kd_tree_leaves"](spark, DATA).collect()}
    members = defaultdict(list)
    for x, node in leaf.items():
        members[node].append(x)
    boxes = {n: (np.min([vectors[x][0] for x in xs], axis=0), np.max([vectors[x][0] for x in xs], axis=0)) for n, xs in members.items()}
    got = defaultdict(list)
    for r in QUERIES["tree_search"](spark, DATA).orderBy("qid", "rank").collect():
        got[r.qid].append(r.id)
    for q in (x for x in vectors if x % 20 == 0):
        v = vectors[q][0]
        bound = {n: float((np.maximum(0, np.maximum(low - v, v - high)) ** 2).sum()) for n, (low, high) in boxes.items()}
        visited = sorted(bound, key=lambda n: (bound[n], n))[:4]
        assert got[q] == [x for _, x in sorted((square(vectors[x][0], v), x) for n in visited for x in members[n])[:10]]


def test_hash_sample_is_a_tenth(spark, vectors):
    rows = QUERIES["hash_sample"](spark, "/root/testdata/sf0.1").collect()
    assert {r.id for r in rows} == {r.id for r in QUERIES["hash_sample"](spark, "/root/testdata/sf0.1").collect()}
    assert 0.07 <= len(rows) / base(spark, "/root/testdata/sf0.1").count() <= 0.13


def test_residual_of_lloyds_iterations(spark, vectors):
    ids = sorted(vectors)
    v = np.array([vectors[x][0] for x in ids])
    c = np.array([vectors[x][0] for x in ids if x % 50 == 0])
    spread = lambda: ((v[:, None] - c[None]) ** 2).sum(-1)
    start = spread().min(axis=1).sum()
    for _ in range(5):
        own = spread().argmin(axis=1)
        c = np.array([v[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
    got = {r.stage: r.residual for r in QUERIES["kmeans_residual"](spark, DATA).collect()}
    assert got["start"] == pytest.approx(start) and got["end"] == pytest.approx(spread().min(axis=1).sum(), rel=1e-3)


def test_approximate_searches_find_most(spark):
    truth = QUERIES["knn_l2"](spark, DATA)
    for name in ("rotated_bit_search", "graph_beam_search", "resumed_graph_search"):
        assert recall(truth, QUERIES[name](spark, DATA), 10).first()["recall"] >= 95, name


def test_errors_of_codes(spark, vectors):
    passes = {r.passes: r.error for r in QUERIES["additive_code_error"](spark, DATA).collect()}
    assert passes[3] <= passes[0]
    # k-means on each chunk, from the rows of the smallest ids
    ids = sorted(vectors)
    v, total = np.array([vectors[x][0] for x in ids]), 0.0
    for j in range(4):
        piece = v[:, 16 * j : 16 * j + 16]
        c = piece[:256].copy()
        for step in range(13):
            d = ((piece[:, None] - c[None]) ** 2).sum(-1)
            if step < 12:
                own = d.argmin(axis=1)
                c = np.array([piece[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        total += d.min(axis=1).mean()
    assert QUERIES["trained_codebook_error"](spark, DATA).first()["error"] == pytest.approx(total, rel=1e-3)
