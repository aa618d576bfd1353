import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nearlake.llm.common import WORD
from nearlake.llm.mixing import invert_demand, mix, mix_documents

from .conftest import edge_rows, prose


def targets_by_rounds(sizes, share=1.5, weights=(5, 2, 1)):
    """The contract's words: deal by weight, stop at twice the size, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, out = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def docs_of(spark, n=400):
    rows = [(i, prose(i, 5 + i % 90), ["a", "b", "z", "ä", None, "hot", "hot", "hot"][i % 8]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


@pytest.mark.parametrize("bucket", [7, 5_000])
def test_mix_reaches_the_targets(spark, bucket):
    docs, rows = docs_of(spark)
    size = {i: len(re.findall(WORD, t)) for i, t, _ in rows}
    by_source = defaultdict(int)
    for i, _, s in rows:
        by_source[s] += size[i]
    want = targets_by_rounds(by_source)
    got = mix(docs, rows_per_bucket=bucket).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(r.taken_by_epoch)
        assert all((n > 0) == (p is not None and 0 <= p <= 1) for n, p in zip(r.taken_by_epoch, r.positions))
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id, r.taken, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, mix(docs.repartition(7), rows_per_bucket=bucket).collect()))
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed)


def test_positions_follow_the_schedule(spark):
    rows = spark.createDataFrame([(x / 50, s / 10) for x in range(51) for s in (-9, -5, 0, 5, 9)], "x double, s double")
    for r in rows.withColumn("t", invert_demand(F.col("x"), F.col("s"))).collect():
        assert r.t + r.s * (r.t**2 - r.t) == pytest.approx(r.x, abs=1e-9) and -1e-9 <= r.t <= 1 + 1e-9


def test_edges(edges, empty):
    got = mix(edges).collect()
    assert len(got) == len(edge_rows())
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix(empty).count() == 0
    assert mix_documents(empty).columns == empty.columns and mix_documents(empty).count() == 0
    unique = edges.dropDuplicates(["doc_id"])
    out = mix_documents(unique)
    assert out.columns == unique.columns
    assert out.groupBy("doc_id").count().where("count > 2").count() == 0


def test_rows_with_equal_ids_are_documents_of_their_own(spark):
    rows = [(i // 3, prose(i, 30), "abc"[i % 3], i, i, {"k": i}) for i in range(60)] + [(None, prose(99, 20), "a", 1, 2, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__position` int, row int, `__of` map<string,int>")
    out = mix_documents(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.text] += 1
    assert set(times) <= {r[1] for r in rows} and max(times.values()) <= 2 and sum(times.values()) >= 1.4 * 61


def test_many_sources(spark):
    rows = [(i, prose(i, 3 + i % 11), f"host-{i % 301:03d}") for i in range(1500)]
    by_source = defaultdict(int)
    for _, text, source in rows:
        by_source[source] += len(re.findall(WORD, text))
    want = targets_by_rounds(by_source)
    got = {r.source: r.target for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {s: pytest.approx(t) for s, t in want.items()}
