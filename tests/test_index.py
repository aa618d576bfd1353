"""Golden neighbours on points of a line, the index object, files, streams, and recall floors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearlake.api import VectorIndex
from nearlake.operators import frontier, graph, inverted, partition, quantize, trees
from nearlake.operators.knn import knn, knn_by_matrix
from nearlake.operators.measures import nearest_rank, recall
from nearlake.plans.inputs import base, stated_queries
from nearlake.sources import binary, text
from nearlake.streaming import updates, windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def line(spark):
    return spark.range(1, 400).select("id", F.array_repeat(F.col("id").cast("float"), 10).alias("v"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.range(1, 4).select(F.col("id").alias("qid"), F.array_repeat((2 * F.col("id")).cast("float"), 10).alias("q"))


def ids_by_query(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("kind", ["exact", "inverted"])
def test_golden_neighbours(line, asked, kind):
    index = VectorIndex(line, kind=kind, depth=3)
    assert ids_by_query(index.search(asked, 3)) == {1: [2, 1, 3], 2: [4, 3, 5], 3: [6, 5, 7]}
    failed = index.delete(line.where("id in (2, 4, 6)").select("id"))
    assert failed.count() == 0 and index.delete(line.where("id in (2, 9)").select("id")).count() == 1
    assert ids_by_query(index.search(asked, 2)) == {1: [1, 3], 2: [3, 5], 3: [5, 7]}
    assert ids_by_query(index.search(asked, 1, with_deleted=True)) == {1: [2], 2: [4], 3: [6]}
    report = index.consolidate().first()
    assert (report.active, report.released, report.kept_tombstones) == (395, 4, 0)
    refused = index.insert(line.where("id in (2, 3)").select("id", "v"))
    assert [r.id for r in refused.collect()] == [3]
    assert ids_by_query(index.search(asked, 1, where=F.col("id") != 5)) == {1: [2], 2: [3], 3: [7]}


def test_save_load_merge(spark, line, asked, tmp_path):
    index = VectorIndex(line)
    index.delete(line.where("id = 2").select("id"))
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    assert ids_by_query(again.search(asked, 2))[1] == [1, 3]
    assert again.merge(VectorIndex(line)).rows.agg(F.max("id")).first()[0] == 399 + 1 + 399
    assert index.vector(2).count() == 0 and index.vector(3).count() == 1
    assert index.within(asked, 10.0).count() == 8


@pytest.mark.parametrize("options", [{"metric": "none"}, {"kind": "none"}, {"metric": "cosine", "kind": "inverted"}, {"depth": -1}, {"replicas": 0}])
def test_bad_settings(line, options):
    with pytest.raises(ValueError):
        VectorIndex(line, **options)


def test_bad_arguments(spark, line, asked):
    with pytest.raises(ValueError):
        VectorIndex(line.select("id"))
    with pytest.raises(ValueError):
        VectorIndex(line).search(asked, 0)
    with pytest.raises(ValueError):
        trees.shards_for_budget(0, 1, 1)
    with pytest.raises(ValueError):
        binary.read_bin(spark, "/nowhere", "float64")
    assert trees.shards_for_budget(1000, 512, 100_000) == 6 and trees.chunks_for_budget(1000, 128, 32_000) == 32


def test_tags_and_fixed_indices(spark, line, asked):
    index = VectorIndex(line.withColumn("tag", F.col("id") + 1000), fixed=True)
    found = index.search_with_tags(asked, 1, with_vectors=True)
    assert {r.qid: (r.tag, r.v[0]) for r in found.collect()} == {1: (1002, 2.0), 2: (1004, 4.0), 3: (1006, 6.0)}
    for change in (lambda: index.insert(line), lambda: index.delete(line.select("id")), index.consolidate, lambda: VectorIndex(line).search_with_tags(asked, 1)):
        with pytest.raises(ValueError):
            change()


def test_matrix_search_keeps_ties_and_skips_rows_without_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i // 10)] * 3) for i in range(60)] + [(99, None)], "id long, v array<double>")
    queries = spark.createDataFrame([(7, [2.0] * 3), (8, None)], "qid long, q array<double>")
    assert [(r.qid, r.id, r.d) for r in knn_by_matrix(rows, queries, 12).orderBy("rank").collect()] == [(7, 20 + i, 0.0) for i in range(10)] + [(7, 10, 3.0), (7, 11, 3.0)]
    with pytest.raises(ValueError):
        knn_by_matrix(rows, queries, 0)


def test_query_blocks_and_matrices_agree(line, asked):
    whole = [tuple(r) for r in knn(line, asked, 5).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in knn(line, asked, 5, block=1).orderBy("qid", "rank").collect()] == whole
    assert [tuple(r) for r in knn_by_matrix(line, asked, 5, block=2).orderBy("qid", "rank").collect()] == whole


@pytest.mark.parametrize("dtype", ["float32", "int8", "uint8"])
@pytest.mark.parametrize("vecs", [False, True])
def test_files_round_trip(spark, tmp_path, dtype, vecs):
    rows = spark.range(0, 500, 1, 3).select("id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: ((F.col("id") + i) % 100).cast("double")).alias("v"))
    shards = binary.write_shards(rows, str(tmp_path / "out"), dtype, vecs).collect()
    assert sum(s.n for s in shards) == 500
    for s in shards:
        read = (binary.read_vecs if vecs else binary.read_bin)(spark, f"{s.path}.{'vecs' if vecs else 'bin'}", dtype)
        ids = binary.read_bin(spark, f"{s.path}_ids_uint32.bin", "uint32").select("id", F.col("v")[0].alias("was"))
        got = read.join(ids, "id").select("was", "v").collect()
        assert len(got) == s.n and all(list(r.v) == [(r.was + i) % 100 for i in range(7)] for r in got)


def test_text_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\t1|2.5|-3|\nb\t0|0|7|\n")
    assert [(r.meta, r.v) for r in text.read_vectors(spark, str(tmp_path / "v.txt")).collect()] == [("a", [1, 2.5, -3]), ("b", [0, 0, 7])]
    (tmp_path / "v.tsv").write_text("1 2\t3\n4 5 6\n")
    assert [r.v for r in text.read_tsv(spark, str(tmp_path / "v.tsv")).collect()] == [[1, 2, 3], [4, 5, 6]]
    lines = spark.createDataFrame([(1, "a, b"), (2, " ")], "id long, line string")
    with pytest.raises(Exception, match="no label for point 2"):
        text.parse_labels(lines).collect()


def test_nearest_rank_is_a_value(spark):
    rows = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 2]], "x double")
    assert {(r.p, r.value) for r in nearest_rank(rows, "x", [0.0, 0.5, 0.99, 1.0]).collect()} == {(0.0, 1.0), (0.5, 4.0), (0.99, 5.0), (1.0, 5.0)}


def test_places_and_splits(spark):
    rows = spark.range(103).select((F.col("id") * 7).alias("id")).repartition(5)
    got = partition.natural_split(rows, 7).orderBy("id").collect()
    assert [r.shard for r in got] == [s for s in range(7) for _ in range(15 if s < 5 else 14)]
    assert [r.local for r in got] == [i for s in range(7) for i in range(15 if s < 5 else 14)]


def floor_of(spark, found):
    truth = knn(base(spark, DATA), stated_queries(spark, DATA), 10)
    return recall(truth, found, 10).first().recall


def test_recall_floors(spark):
    rows, queries = base(spark, DATA), stated_queries(spark, DATA)
    center = spark.createDataFrame([(0, [0.0] * 64)], "cid long, c array<double>")
    d = quantize.bit_code_candidates(quantize.rotated_bit_codes(rows, center, 4), queries, center, 30, 4)
    assert floor_of(spark, inverted.rerank(d, rows, queries, 30, 10)) > 90
    edges = graph.both_ways(graph.pruned(graph.knn_graph(rows, 24), rows, 12))
    entry = queries.select("qid", F.lit(0).cast("long").alias("id"))
    found = frontier.frontier_search(edges, rows, queries, entry, 10, 80)
    assert floor_of(spark, found) > 85
    heads = trees.select_heads(rows, 4)
    everything = inverted.search(rows, inverted.postings(rows, heads, 1), inverted.probes(queries, heads, 16), queries, 10)
    assert floor_of(spark, everything) == 100


def test_passes_lower_the_error_of_additive_codes(spark):
    rows = base(spark, DATA)
    books = quantize.train_additive_codebooks(rows, 4, 16)
    before, after = (quantize.additive_codes(rows, books, n).agg(F.avg("error")).first()[0] for n in (0, 3))
    assert after < before < 1


def test_lloyd_lowers_the_residual(spark):
    rows = base(spark, DATA)
    start = rows.where("id % 50 = 0").select(F.col("id").alias("cid"), F.col("v").alias("c"))
    total = lambda c: partition.nearest_centroids(rows, c).agg(F.sum("cd")).first()[0]
    assert total(partition.lloyd(rows, start, 4)) < total(start)


def test_pages_hold_at_most_their_capacity(spark):
    rows = base(spark, DATA).where("id < 200")
    edges = graph.knn_graph(rows, 4)
    for pages in (
        graph.pages_by_growth(edges, rows.select("id", F.lit(1).alias("freq")), 8),
        graph.pages_by_votes(edges, rows.select("id"), 8, 3),
    ):
        assert pages.count() == 200 and pages.groupBy("page").count().agg(F.max("count")).first()[0] <= 8


def test_snapshots_of_a_stream(spark, tmp_path):
    schema = "seq long, op string, id long, v array<double>"
    first = [(1, "insert", 1, [1.0]), (2, "insert", 2, [2.0]), (3, "delete", 1, None)]
    second = [(4, "insert", 3, [3.0]), (5, "insert", 2, [9.0])]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        updates.start_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, updates.snapshot(spark, str(tmp_path / "out"), 0).collect())) == [(2, [2.0])]
    assert sorted(map(tuple, updates.snapshot(spark, str(tmp_path / "out"), 1).collect())) == [(2, [9.0]), (3, [3.0])]


def test_windows_of_a_stream_match_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("by_hour").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("by_hour").collect())) == sorted(map(key, windows.tumbling(events, "1 hour").collect()))


def test_distances_against_numpy(spark):
    random = np.random.default_rng(5)
    a, b = random.integers(-5, 6, (2, 40, 17)).astype(float)
    rows = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")
    from nearlake.functions.vectors import METRICS

    want = {
        "l2": ((a - b) ** 2).sum(1),
        "inner_product": -(a * b).sum(1),
        "cosine": 1 - (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)),
        "fast_l2": (a * a).sum(1) - 2 * (a * b).sum(1),
        "hamming": (a != b).sum(1),
    }
    for name, values in want.items():
        got = [r[0] for r in rows.select(METRICS[name](F.col("a"), F.col("b"))).collect()]
        assert np.allclose(got, values), name


def odd_rows(spark):
    """Forty rows, of which one is NaN, one infinite, one null, one with a null component, one shorter, one huge."""
    rows = [(i, [float(i), float(i % 7)]) for i in range(34)]
    rows += [(34, [float("nan"), 1.0]), (35, [float("inf"), 1.0]), (36, None), (37, [None, 1.0]), (38, [1.0]), (39, [1e160, 0.0])]
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_matrix_search_survives_odd_vectors(spark):
    asked = spark.createDataFrame([(1, [3.0, 3.0]), (2, [float("nan"), 0.0]), (3, None), (4, [1.5]), (5, [None, 2.0]), (6, [1e5, 0.0])], "qid long, q array<double>")
    found = ids_by_query(knn(odd_rows(spark).coalesce(1), asked, 3))
    assert found == {1: [3, 2, 4], 2: [0, 1, 2], 4: [38], 6: [33, 32, 31]}


def test_odd_distances_come_last(spark):
    asked = spark.createDataFrame([(1, [3.0, 3.0])], "qid long, q array<double>")
    for parts in (1, 5):
        found = knn(odd_rows(spark).repartition(parts), asked, 50).orderBy("rank").collect()
        assert [r.id for r in found][-3:] == [35, 39, 34]  # infinite, then no number
        assert len(found) == 37
        same = knn(odd_rows(spark), asked, 50, condition=F.lit(True)).orderBy("rank").collect()
        assert [r.id for r in found] == [r.id for r in same]


def test_no_queries_no_rows(spark, line):
    none = spark.createDataFrame([], "qid long, q array<double>")
    nulls = spark.createDataFrame([(1, None)], "qid long, q array<double>")
    for asked in (none, nulls):
        assert knn(line, asked, 3).collect() == []
        for kind in ("exact", "inverted"):
            assert VectorIndex(line, kind=kind, depth=2).search(asked, 3).collect() == []


def test_filtered_inverted_search_finds_k(spark, line, asked):
    index = VectorIndex(line, kind="inverted", depth=4, replicas=1)
    rare = F.col("id") % 80 == 0  # four rows besides 80, far from the lists that are probed
    found = ids_by_query(index.search(asked, 4, where=rare, probes=1))
    assert found == ids_by_query(VectorIndex(line).search(asked, 4, where=rare)) and all(len(x) == 4 for x in found.values())
    index.delete(spark.range(1, 60).select("id"))
    assert ids_by_query(index.search(asked, 3, probes=1)) == {1: [60, 61, 62], 2: [60, 61, 62], 3: [60, 61, 62]}


def test_loaded_index_keeps_its_lists(spark, line, asked, tmp_path):
    index = VectorIndex(line, kind="inverted", depth=3)
    index.save(str(tmp_path / "kept"))
    other = VectorIndex.load(spark, str(tmp_path / "kept"))
    for mine, saved in zip(index._inverted(), other._inverted()):
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, saved.collect()))
    assert ids_by_query(other.search(asked, 5)) == ids_by_query(index.search(asked, 5))


def test_graph_index_through_its_life(spark, asked, tmp_path):
    """Built, searched, grown, thinned out, saved and read: as the exact index on points of a line."""
    points = spark.range(1, 241).select("id", F.array_repeat(F.col("id").cast("float"), 6).alias("v"))
    queries = asked.select("qid", F.slice("q", 1, 6).alias("q"))
    first, more = points.where("id % 3 <> 0"), points.where("id % 3 = 0")
    index, exact = (VectorIndex(first, kind=kind, degree=6, width=12) for kind in ("graph", "exact"))
    assert ids_by_query(index.search(queries, 3)) == ids_by_query(exact.search(queries, 3))
    for each in (index, exact):
        assert [r.id for r in each.insert(more.unionByName(points.where("id = 5"))).collect()] == [5]
        each.delete(points.where("id between 4 and 7").select("id"))
    edges = index._graph()
    assert edges.groupBy("src").count().agg(F.max("count")).first()[0] <= 6
    assert edges.where("src % 3 = 0").select("src").distinct().count() == 80
    want = ids_by_query(exact.search(queries, 4))
    assert ids_by_query(index.search(queries, 4)) == want
    assert ids_by_query(index.search(queries, 2, where=F.col("id") > 200)) == ids_by_query(exact.search(queries, 2, where=F.col("id") > 200))
    assert index.consolidate().first().released == 4
    assert index._graph().where("src between 4 and 7 OR dst between 4 and 7").count() == 0
    index.save(str(tmp_path / "graph"))
    again = VectorIndex.load(spark, str(tmp_path / "graph"))
    assert again._edges is not None and ids_by_query(again.search(queries, 4)) == want


def test_codebooks_are_saved_and_codes_packed(spark, tmp_path):
    rows = base(spark, DATA)
    book = quantize.train_codebook(rows, 8, 8, 16, 4)
    quantize.save_codebook(book, str(tmp_path / "book"))
    kept = quantize.load_codebook(spark, str(tmp_path / "book"))
    codes = lambda b: {r.id: r.codes for r in quantize.product_codes(rows, b, 8).collect()}
    assert codes(book) == codes(kept) and len(codes(book)) == rows.count()
    packed = quantize.product_codes(rows, book, 8).select("codes", quantize.packed_nibbles(F.col("codes")).alias("p"))
    assert packed.where((F.octet_length("p") != 4) | (quantize.unpacked_nibbles(F.col("p"), 8) != F.col("codes"))).count() == 0
    error = lambda b: rows.join(quantize.decoded(quantize.product_codes(rows, b, 8), b).toDF("id", "w"), "id").agg(F.sum(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))).first()[0]
    assert error(book) < error(quantize.codebook_from_rows(rows, 8, 8, 16))
    with pytest.raises(ValueError):
        rows.write.parquet(str(tmp_path / "rows"))
        quantize.load_codebook(spark, str(tmp_path / "rows"))
