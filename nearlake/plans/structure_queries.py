"""Named queries on segmentation, quantizers, inverted lists and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearlake.functions import vectors as V
from nearlake.operators import clusters as C
from nearlake.operators import frontier as X
from nearlake.operators import graph as G
from nearlake.operators import inverted as I
from nearlake.operators import partition as P
from nearlake.operators import quantize as Q
from nearlake.operators import trees as T
from nearlake.operators.knn import knn, knn_by_group, scored_pairs, top_k
from nearlake.operators.measures import share_of
from nearlake.operators.tables import settled
from nearlake.plans import sql as S
from nearlake.plans.inputs import base, centroids, stated_queries
from nearlake.plans.registry import query

# --- segmentation ---------------------------------------------------------------------------


@query("natural_split", "SELECT id, shard, row_number() OVER (PARTITION BY shard ORDER BY id) - 1 AS local FROM (SELECT vec_id AS id, ntile(7) OVER (ORDER BY vec_id) - 1 AS shard FROM embeddings)")
def natural_split(spark, sf_dir):
    return P.natural_split(base(spark, sf_dir).select("id"), 7)


_CENTROIDS = "(SELECT vec_id AS cid, embedding AS c FROM embeddings WHERE vec_id % 50 = 0)"


def _nearest(k: int, rows: str = S.BASE) -> str:
    return f"SELECT id, rank, cid, cd FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cd, cid) AS rank FROM (SELECT id, cid, {S.l2('v', 'c')} AS cd FROM {rows}, {_CENTROIDS})) WHERE rank <= {k}"


@query("centroid_assign", f"SELECT id, cid, cd FROM ({_nearest(1)})")
def centroid_assign(spark, sf_dir):
    return P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)).select("id", "cid", "cd")


@query("replicated_assign", _nearest(3))
def replicated_assign(spark, sf_dir):
    return P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir), 3).select("id", "rank", "cid", "cd")


@query("query_routing", _nearest(4, "(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)"))
def query_routing(spark, sf_dir):
    queries = stated_queries(spark, sf_dir).select(F.col("qid").alias("id"), F.col("q").alias("v"))
    return P.nearest_centroids(queries, centroids(spark, sf_dir), 4)[["id", "rank", "cid", "cd"]]


@query("cluster_sizes", f"SELECT cid, count(*) AS n FROM ({_nearest(1)}) GROUP BY cid")
def cluster_sizes(spark, sf_dir):
    return P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)).groupBy("cid").agg(F.count("*").alias("n"))


@query("lloyd_step", f"SELECT cid, i, round(avg(x), 6) AS x, count(*) AS n FROM (SELECT a.cid, unnest(e.embedding)::double AS x, generate_subscripts(e.embedding, 1) - 1 AS i FROM ({_nearest(1)}) a JOIN embeddings e ON e.vec_id = a.id) GROUP BY cid, i")
def lloyd_step(spark, sf_dir):
    means = P.mean_vectors(P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)), digits=6)
    return means.select("cid", "n", F.posexplode("c").alias("i", "x"))


@query("kmeans_residual")
def kmeans_residual(spark, sf_dir):
    """Residual after Lloyd's iterations: no more than before them."""
    rows, start = base(spark, sf_dir), centroids(spark, sf_dir)
    end = P.lloyd(rows, start, 5)
    total = lambda c: P.nearest_centroids(rows, c).agg(F.sum("cd").alias("residual"))
    return total(start).withColumn("stage", F.lit("start")).unionByName(total(end).withColumn("stage", F.lit("end")))


@query("kmeans_plus_plus")
def kmeans_plus_plus(spark, sf_dir):
    """Twelve centroids drawn by squared distances, the best of 15 starts."""
    return C.plus_plus(base(spark, sf_dir), 12)


@query("fitting_partition")
def fitting_partition(spark, sf_dir):
    """Parts of at most an eighth of the rows each."""
    rows = base(spark, sf_dir)
    return C.fitting_partition(rows, max(1, rows.count() // 8))


@query("residual_vectors", f"SELECT a.id, list_transform(list_zip(e.embedding, c.embedding), lambda z: z[1]::double - z[2]::double) AS r FROM ({_nearest(1)}) a JOIN embeddings e ON e.vec_id = a.id JOIN embeddings c ON c.vec_id = a.cid")
def residual_vectors(spark, sf_dir):
    return P.residuals(P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)), centroids(spark, sf_dir)).select("id", "r")


@query("cluster_and_permute", f"SELECT id, cid, row_number() OVER (ORDER BY cid, id) - 1 AS place FROM ({_nearest(1)})")
def cluster_and_permute(spark, sf_dir):
    assigned = P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)).select(F.struct("cid", "id").alias("key"))
    return P.with_places(assigned, "key").select("key.id", "key.cid", "place")


@query("segment_tree_split", f"WITH m AS (SELECT vec_id AS id, list_sum(list_transform(embedding[1:16], lambda x: x::double)) / 16 AS m FROM embeddings) SELECT id, m < (SELECT (max(m) + min(m)) / 2 FROM m) AS left FROM m".replace(" AS left FROM", ' AS "left" FROM'))
def segment_tree_split(spark, sf_dir):
    means = base(spark, sf_dir).select("id", V.mean(V.part(F.col("v"), 0, 16)).alias("m"))
    return P.split_at_middle(means, "m").select("id", "left")


@query("segment_tree_search", S.KNN10)
def segment_tree_search(spark, sf_dir):
    """Exact search by a tree over eight segments, five levels deep, and the bounds of its leaves."""
    leaves = T.segment_tree(base(spark, sf_dir).select("id", "v"), 8, 8, 5)
    return T.segment_search(leaves, stated_queries(spark, sf_dir), 8, 8, 10, 2)


@query("dimension_variances", "SELECT i, round(var_pop(x), 6) AS var, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i ORDER BY var DESC, i LIMIT 5")
def dimension_variances(spark, sf_dir):
    """The five dimensions with the largest variance, from which a tree's split is drawn."""
    parts = base(spark, sf_dir).select(F.posexplode(V.doubles(F.col("v"))).alias("i", "x"))
    return parts.groupBy("i").agg(F.round(F.var_pop("x"), 6).alias("var"), F.round(F.avg("x"), 6).alias("mean")).orderBy(F.desc("var"), "i").limit(5)


@query("shard_extraction", f"SELECT id, label FROM {S.BASE} WHERE id IN (SELECT id FROM ({_nearest(1)}) WHERE cid = 50)")
def shard_extraction(spark, sf_dir):
    ids = P.nearest_centroids(base(spark, sf_dir), centroids(spark, sf_dir)).where("cid = 50").select("id")
    return base(spark, sf_dir).join(ids, "id", "left_semi").select("id", "label")


@query("page_layout", "SELECT vec_id AS id, vec_id // 8 AS page, vec_id % 8 AS slot FROM embeddings")
def page_layout(spark, sf_dir):
    rows = base(spark, sf_dir).select("id", F.floor(F.col("id") / 8).alias("page"), (F.col("id") % 8).alias("slot"))
    return rows.repartitionByRange("page").sortWithinPartitions("page", "slot")


# --- shards and merges ----------------------------------------------------------------------

_SHARDED = f"SELECT qid, id, d, id % 4 AS shard, row_number() OVER (PARTITION BY qid, id % 4 ORDER BY d, id) AS place FROM ({S.SCORED})"


def _sharded(spark, sf_dir):
    return base(spark, sf_dir).withColumn("shard", F.col("id") % 4)


@query("multi_shard_merge", S.KNN10)
def multi_shard_merge(spark, sf_dir):
    queries = stated_queries(spark, sf_dir)
    shards = F.explode(F.array(F.col("id") % 4, (F.col("id") + 3) % 4))
    return P.search_shards(base(spark, sf_dir).withColumn("shard", shards), queries, 10).select("qid", "rank", "id", "d")


@query("merge_keeping_shard", f"SELECT qid, rank, id, shard FROM ({S.top(_SHARDED.replace('SELECT qid', 'SELECT qid', 1), 10)})")
def merge_keeping_shard(spark, sf_dir):
    found = knn_by_group(_sharded(spark, sf_dir), stated_queries(spark, sf_dir), 10, "shard")
    return top_k(found, 10).select("qid", "rank", "id", "shard")


@query("aggregator_concatenation", f"SELECT qid, shard, place, id FROM ({_SHARDED}) WHERE place <= 3")
def aggregator_concatenation(spark, sf_dir):
    return knn_by_group(_sharded(spark, sf_dir), stated_queries(spark, sf_dir), 3, "shard").select("qid", "shard", "place", "id")


@query("shard_contributions", f"SELECT id % 4 AS shard, count(*) AS n, round(100.0 * count(*) / (SELECT 10 * count(*) FROM embeddings WHERE vec_id % 20 = 0), 6)::double AS percent FROM ({S.KNN10}) GROUP BY id % 4")
def shard_contributions(spark, sf_dir):
    found = knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 10).withColumn("shard", F.col("id") % 4)
    return share_of(found, "shard", F.lit(10 * stated_queries(spark, sf_dir).count()))


@query("local_to_global_ids", f"WITH s AS (SELECT vec_id AS id, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1 AS local, vec_id % 4 AS shard FROM embeddings) SELECT k.qid, k.rank, s.shard, s.local, k.id FROM ({S.KNN10}) k JOIN s ON s.id = k.id")
def local_to_global_ids(spark, sf_dir):
    found = knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 10)
    ids = G.local_ids(_sharded(spark, sf_dir).select("shard", "id"))
    return found.join(ids, "id").select("qid", "rank", "shard", "local", "id")


@query("metadata_of_results", f"SELECT k.qid, k.rank, k.id, e.label, 'item-' || e.vec_id AS meta FROM ({S.KNN10}) k LEFT JOIN embeddings e ON e.vec_id = k.id")
def metadata_of_results(spark, sf_dir):
    meta = base(spark, sf_dir).select("id", "label", F.concat(F.lit("item-"), F.col("id")).alias("meta"))
    return knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 10).join(meta, "id", "left").select("qid", "rank", "id", "label", "meta")


def _adaptive_sql(k: int, start: int, big: int, small: int, end: int, rounds: int) -> str:
    """The rounds written out: depths of one round from those of the round before."""
    parts = [f"r AS ({_SHARDED})", f"d0 AS (SELECT DISTINCT qid, shard, {start} AS depth FROM r)"]
    for i in range(rounds):
        parts.append(
            f"o{i} AS (SELECT DISTINCT qid, shard FROM (SELECT r.qid, r.shard, row_number() OVER (PARTITION BY r.qid ORDER BY r.d, r.id) AS n FROM r JOIN d{i} d ON r.qid = d.qid AND r.shard = d.shard AND r.place <= d.depth) WHERE n <= {k})"
        )
        parts.append(
            f"d{i + 1} AS (SELECT d.qid, d.shard, CASE WHEN sum(d.depth) OVER (PARTITION BY d.qid) < {end} THEN d.depth + CASE WHEN o.qid IS NULL THEN {small} ELSE {big} END ELSE d.depth END AS depth FROM d{i} d LEFT JOIN o{i} o ON o.qid = d.qid AND o.shard = d.shard)"
        )
    return "WITH " + ", ".join(parts) + f" SELECT r.qid, r.id, r.shard FROM (SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY r.d, r.id) AS rank FROM r JOIN d{rounds} d ON r.qid = d.qid AND r.shard = d.shard AND r.place <= d.depth) r WHERE rank <= {k}"


@query("adaptive_multi_shard_search", _adaptive_sql(10, 2, 2, 1, 16, 4))
def adaptive_multi_shard_search(spark, sf_dir):
    found = I.adaptive_search(_sharded(spark, sf_dir), stated_queries(spark, sf_dir), 10, start=2, big=2, small=1, end=16)
    return found.select("qid", "id", "shard")


_RADIUS_SQL = f"""WITH r AS ({_SHARDED}), f AS (SELECT * FROM (SELECT qid, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS n FROM r WHERE place <= 3) WHERE n <= 5),
    w AS (SELECT qid, max(d) * 1.05 AS radius FROM f GROUP BY qid),
    b AS (SELECT r.qid, r.shard, min(place) AS stop FROM r JOIN w USING (qid) WHERE place >= 3 AND (place - 3) % 2 = 0 AND d > radius GROUP BY r.qid, r.shard),
    n AS (SELECT qid, shard, count(*) AS n FROM r GROUP BY qid, shard)
    SELECT n.qid, n.shard, least(coalesce(stop, 25), 25, n) AS depth FROM n LEFT JOIN b ON b.qid = n.qid AND b.shard = n.shard"""


@query("radius_scheduled_depths", _RADIUS_SQL)
def radius_scheduled_depths(spark, sf_dir):
    """How deep each of four shards is read while it gives rows within each query's radius."""
    # a shard is never read beyond the capacity
    ranked = settled(knn_by_group(_sharded(spark, sf_dir), stated_queries(spark, sf_dir), 25, "shard"))
    return I.radius_rounds(ranked, 5, 3, 2, 25, 1.05)


@query("radius_scheduled_search", f"WITH z AS ({_RADIUS_SQL}) SELECT qid, rank, id, shard FROM ({S.top(f'SELECT r.qid, r.id, r.d, r.shard FROM ({_SHARDED}) r JOIN z ON z.qid = r.qid AND z.shard = r.shard AND r.place <= z.depth', 8)})")
def radius_scheduled_search(spark, sf_dir):
    """The best eight of what the shards give within those depths."""
    ranked = settled(knn_by_group(_sharded(spark, sf_dir), stated_queries(spark, sf_dir), 25, "shard"))
    depths = I.radius_rounds(ranked, 5, 3, 2, 25, 1.05)
    return top_k(ranked.join(depths, ["qid", "shard"]).where(F.col("place") <= F.col("depth")), 8).select("qid", "rank", "id", "shard")


_TABLES = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, t, id) AS rank FROM (SELECT qid, id, d, 0 AS t FROM ({S.KNN10}) WHERE rank <= 4 UNION ALL SELECT qid, id, d, 1 AS t FROM ({S.KNN10}) WHERE rank BETWEEN 2 AND 3)"


@query("merge_with_repeats", f"WITH m AS ({_TABLES}) SELECT q.qid, q.rank, coalesce(m.id, 0) AS id, m.d FROM (SELECT vec_id AS qid, unnest(range(1, 9)) AS rank FROM embeddings WHERE vec_id % 20 = 0) q LEFT JOIN m ON m.qid = q.qid AND m.rank = q.rank")
def merge_with_repeats(spark, sf_dir):
    """Two result tables that share ids as one, by distance alone; each query has eight rows, those beyond what there is filled."""
    found = settled(knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 4))
    return P.concatenated_ranking([found, found.where("rank BETWEEN 2 AND 3")], 8, fill=True)


# --- quantizers -----------------------------------------------------------------------------

_CHUNKS, _WIDTH = 4, 16


def _book(spark, sf_dir):
    """256 centroids a chunk, trained on all rows: the chunks of the rows of the smallest ids, moved once."""
    return Q.train_codebook(base(spark, sf_dir), _CHUNKS, _WIDTH, Q.CENTROIDS, 1)


_CHUNK = "e.embedding[b.j * 16 + 1:b.j * 16 + 16]"
_ASSIGN = f"SELECT id, j, code FROM (SELECT e.vec_id AS id, b.j, b.code, row_number() OVER (PARTITION BY e.vec_id, b.j ORDER BY {S.l2(_CHUNK, 'b.c')}, b.code) AS n FROM embeddings e, {{book}} b) WHERE n = 1"
_CODES = f"""b0 AS (SELECT code, j, embedding[j * 16 + 1:j * 16 + 16] AS c FROM (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS code FROM embeddings) r, range(0, 4) t(j) WHERE code < 256),
    n0 AS ({_ASSIGN.format(book='b0')}),
    m0 AS (SELECT j, code, list(x ORDER BY i) AS c FROM (SELECT j, code, i, round(avg(x), 9) AS x FROM (SELECT n.j, n.code, unnest(e.embedding[n.j * 16 + 1:n.j * 16 + 16])::double AS x, generate_subscripts(e.embedding[n.j * 16 + 1:n.j * 16 + 16], 1) AS i FROM n0 n JOIN embeddings e ON e.vec_id = n.id) GROUP BY j, code, i) GROUP BY j, code),
    book AS (SELECT b.code, b.j, coalesce(m.c, b.c::double[]) AS c FROM b0 b LEFT JOIN m0 m ON m.j = b.j AND m.code = b.code),
    near AS ({_ASSIGN.format(book='book')})"""


@query("product_codes", f"WITH {_CODES} SELECT id, list(code ORDER BY j) AS codes FROM near GROUP BY id")
def product_codes(spark, sf_dir):
    return Q.product_codes(base(spark, sf_dir), _book(spark, sf_dir), _WIDTH)


@query("product_decode", f"WITH {_CODES}, p AS (SELECT n.id, n.j * 16 + u.i AS place, u.x FROM near n JOIN book b ON b.j = n.j AND b.code = n.code, LATERAL (SELECT unnest(b.c)::double AS x, generate_subscripts(b.c, 1) AS i) u) SELECT id, list(x ORDER BY place) AS v FROM p GROUP BY id")
def product_decode(spark, sf_dir):
    book = _book(spark, sf_dir)
    return Q.decoded(Q.product_codes(base(spark, sf_dir), book, _WIDTH), book)


_ADC = f"""adc AS (SELECT q.vec_id AS qid, n.id, list_sum(list({S.l2('q.embedding[n.j * 16 + 1:n.j * 16 + 16]', 'b.c')} ORDER BY n.j)) AS d FROM near n JOIN book b ON b.j = n.j AND b.code = n.code, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, n.id)"""


@query("asymmetric_distance_topk", f"WITH {_CODES}, {_ADC} SELECT qid, rank, id, round(d, 9) AS d FROM ({S.top('SELECT * FROM adc', 10)})")
def asymmetric_distance_topk(spark, sf_dir):
    book = _book(spark, sf_dir)
    near = Q.asymmetric_nearest(Q.product_codes(base(spark, sf_dir), book, _WIDTH), stated_queries(spark, sf_dir), book, _WIDTH, 10)
    return near.select("qid", "rank", "id", F.round("d", 9).alias("d"))


@query("symmetric_distance", f"WITH {_CODES} SELECT q.id AS qid, n.id, round(sum({S.l2('a.c', 'b.c')}), 9) AS d FROM near n JOIN near q ON q.j = n.j AND q.id % 20 = 0 JOIN book a ON a.j = n.j AND a.code = n.code JOIN book b ON b.j = q.j AND b.code = q.code GROUP BY q.id, n.id")
def symmetric_distance(spark, sf_dir):
    book = _book(spark, sf_dir)
    coded = settled(Q.product_codes(base(spark, sf_dir), book, _WIDTH))
    few = coded.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("codes").alias("qcodes"))
    return Q.symmetric_distances(coded, few, book, 9)


@query("two_phase_search", f"WITH {_CODES}, {_ADC}, best AS ({S.top('SELECT qid, id, d FROM adc', 40)}), x AS (SELECT best.qid, best.id, {S.l2('e.embedding', 'q.embedding')} AS d FROM best JOIN embeddings e ON e.vec_id = best.id JOIN embeddings q ON q.vec_id = best.qid) SELECT qid, rank, id, d FROM ({S.top('SELECT * FROM x', 10)})")
def two_phase_search(spark, sf_dir):
    """Approximate distances choose forty rows of each query, exact ones rank them."""
    book, queries = _book(spark, sf_dir), stated_queries(spark, sf_dir)
    near = Q.asymmetric_nearest(Q.product_codes(base(spark, sf_dir), book, _WIDTH), queries, book, _WIDTH, 40)
    return I.rerank(near.drop("rank"), base(spark, sf_dir), queries, 40, 10).select("qid", "rank", "id", "d")


@query("approximate_prefilter", f"WITH {_CODES}, {_ADC}, best AS ({S.top('SELECT qid, id, d FROM adc', 10)}), w AS (SELECT qid, max(d) AS worst FROM best GROUP BY qid) SELECT a.qid, count(*) AS n FROM adc a JOIN w ON a.qid = w.qid WHERE a.d < w.worst * 1.2 GROUP BY a.qid")
def approximate_prefilter(spark, sf_dir):
    """Rows whose approximate distance is below 1.2 times that of the tenth best."""
    book, queries = _book(spark, sf_dir), stated_queries(spark, sf_dir)
    coded = settled(Q.product_codes(base(spark, sf_dir), book, _WIDTH))
    worst = Q.asymmetric_nearest(coded, queries, book, _WIDTH, 10).groupBy("qid").agg((F.max("d") * 1.2).alias("limit"))
    return Q.asymmetric_counts(coded, queries.join(worst, "qid"), book, _WIDTH)


@query("scalar_codes", """
    WITH x AS (SELECT vec_id AS id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i)
    SELECT id, list(CASE WHEN hi > lo THEN round((x - lo) / ((hi - lo) / 255.0::double))::int ELSE 0 END ORDER BY x.i) AS codes FROM x JOIN r ON x.i = r.i GROUP BY id""")
def scalar_codes(spark, sf_dir):
    rows = base(spark, sf_dir)
    return Q.scalar_codes(rows, Q.minmax_per_dimension(rows))


_SQ = """x AS (SELECT vec_id AS id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i),
    dec AS (SELECT id, list(lo + (CASE WHEN hi > lo THEN round((x - lo) / ((hi - lo) / 255.0::double))::int ELSE 0 END) * ((hi - lo) / 255.0::double) ORDER BY x.i) AS v FROM x JOIN r ON x.i = r.i GROUP BY id)"""


@query("scalar_code_search", f"WITH {_SQ}, best AS ({S.top(f'SELECT qid, id, {S.l2("v", "q")} AS d FROM dec, {S.QUERIES} t', 30)}), f AS (SELECT b.qid, b.id, {S.l2('e.embedding', 'q.embedding')} AS d FROM best b JOIN embeddings e ON e.vec_id = b.id JOIN embeddings q ON q.vec_id = b.qid) SELECT qid, rank, id, d FROM ({S.top('SELECT * FROM f', 10)})")
def scalar_code_search(spark, sf_dir):
    """Thirty candidates by what one byte a component tells, ranked exactly."""
    rows, queries = base(spark, sf_dir), stated_queries(spark, sf_dir)
    ranges = settled(Q.minmax_per_dimension(rows))
    near = knn(Q.scalar_decoded(Q.scalar_codes(rows, ranges), ranges), queries, 30)
    return I.rerank(near.drop("rank"), rows, queries, 30, 10).select("qid", "rank", "id", "d")


@query("packed_codes", "SELECT vec_id AS id, list_transform(embedding[1:15], lambda x: least(15, greatest(0, floor(x::double * 16 + 8)))::int) AS codes, 8::bigint AS n_bytes FROM embeddings")
def packed_codes(spark, sf_dir):
    """Codes of four bits, two a byte, packed and read back."""
    code = F.transform(F.slice(V.doubles(F.col("v")), 1, 15), lambda x: F.least(F.lit(15), F.greatest(F.lit(0), F.floor(x * 16 + 8))).cast("int"))
    packed = base(spark, sf_dir).select("id", Q.packed_nibbles(code).alias("p"))
    return packed.select("id", Q.unpacked_nibbles(F.col("p"), 15).alias("codes"), F.octet_length("p").cast("long").alias("n_bytes"))


@query("trained_codebook_error")
def trained_codebook_error(spark, sf_dir):
    """Mean squared error of a trained product codebook."""
    rows = base(spark, sf_dir)
    book = Q.train_codebook(rows, _CHUNKS, _WIDTH)
    back = Q.decoded(Q.product_codes(rows, book, _WIDTH), book).withColumnRenamed("v", "w")
    return rows.join(back, "id").agg(F.avg(V.l2(F.col("v"), F.col("w"))).alias("error"))


def _centers(spark, sf_dir, k):
    """Centers of all rows: a start by squared distances, then five steps of Lloyd's."""
    rows = base(spark, sf_dir)
    return P.lloyd(rows, C.plus_plus(rows, k, 3), 5)


@query("rotated_bit_search")
def rotated_bit_search(spark, sf_dir):
    """Candidates by estimates from 4-bit codes of what lies between rows and 16 centers, rotated at random; ranked exactly."""
    rows, queries, centers = base(spark, sf_dir), stated_queries(spark, sf_dir), _centers(spark, sf_dir, 16)
    near = Q.bit_code_candidates(settled(Q.rotated_bit_codes(rows, centers, 4)), queries, centers, 40, 4)
    return I.rerank(near, rows, queries, 40, 10).select("qid", "rank", "id", "d")


@query("rotated_bit_error")
def rotated_bit_error(spark, sf_dir):
    """Mean squared error of rows rebuilt from codes of 1, 4 and 8 bits."""
    rows, centers = base(spark, sf_dir), _centers(spark, sf_dir, 16)
    dim = rows.select(F.size("v")).first()[0]
    error = lambda bits: rows.join(Q.decoded_bit_codes(Q.rotated_bit_codes(rows, centers, bits), centers, dim, bits).toDF("id", "w"), "id").agg(F.lit(bits).alias("bits"), F.avg(V.l2(F.col("v"), F.col("w"))).alias("error"))
    return error(1).unionByName(error(4)).unionByName(error(8))


@query("additive_code_error")
def additive_code_error(spark, sf_dir):
    """Mean squared error of additive codes, with and without the passes that improve them."""
    rows = base(spark, sf_dir)
    books = Q.train_additive_codebooks(rows, 4, 16)
    error = lambda passes: Q.additive_codes(rows, books, passes).agg(F.lit(passes).alias("passes"), F.avg("error").alias("error"))
    return error(0).unionByName(error(3))


# --- inverted lists -------------------------------------------------------------------------

_LISTS = f"lists AS (SELECT cid, id, cd FROM ({_nearest(2)}))"
_PROBES = f"probes AS (SELECT id AS qid, cid FROM ({_nearest(3, '(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)')}))"
_FOUND = f"found AS (SELECT c.qid, c.id, {S.l2('e.embedding', 'q.embedding')} AS d FROM (SELECT DISTINCT qid, id FROM probes JOIN lists USING (cid)) c JOIN embeddings e ON e.vec_id = c.id JOIN embeddings q ON q.vec_id = c.qid)"


@query("inverted_list_search", f"WITH {_LISTS}, {_PROBES}, {_FOUND} SELECT qid, rank, id, d FROM ({S.top('SELECT * FROM found', 10)})")
def inverted_list_search(spark, sf_dir):
    rows, heads, queries = base(spark, sf_dir), centroids(spark, sf_dir), stated_queries(spark, sf_dir)
    return I.search(rows, I.postings(rows, heads, 2), I.probes(queries, heads, 3), queries, 10, 2).select("qid", "rank", "id", "d")


@query("limited_postings", f"WITH {_LISTS} SELECT cid, id FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY cd, id) AS n FROM lists) WHERE n <= 30")
def limited_postings(spark, sf_dir):
    return I.postings(base(spark, sf_dir), centroids(spark, sf_dir), 2, 30).select("cid", "id")


_SPREAD = f"""WITH RECURSIVE n AS (SELECT n.*, c.embedding AS c FROM ({_nearest(8)}) n JOIN embeddings c ON c.vec_id = n.cid),
    o AS (SELECT b.id, b.rank, list(a.cid) AS by FROM n a JOIN n b ON a.id = b.id AND a.rank < b.rank WHERE {S.l2('a.c', 'b.c')} <= b.cd GROUP BY b.id, b.rank),
    f(id, rank, kept) AS (SELECT vec_id, 0::bigint, []::bigint[] FROM embeddings UNION ALL SELECT f.id, n.rank, CASE WHEN len(f.kept) < 4 AND NOT list_has_any(f.kept, coalesce(o.by, []::bigint[])) THEN list_append(f.kept, n.cid) ELSE f.kept END
        FROM f JOIN n ON n.id = f.id AND n.rank = f.rank + 1 LEFT JOIN o ON o.id = n.id AND o.rank = n.rank)
    SELECT id, unnest(kept) AS cid FROM f WHERE rank = (SELECT max(rank) FROM n)"""


@query("spread_postings", _SPREAD)
def spread_postings(spark, sf_dir):
    """Each row in the lists of up to four heads of its nearest eight, none of which another one hides."""
    return I.spread_postings(base(spark, sf_dir), centroids(spark, sf_dir), 4, 8).select("id", "cid")


@query("heads_by_ratio")
def heads_by_ratio(spark, sf_dir):
    """A fifth of the rows as heads, from a tree whose largest leaves are split first."""
    return T.heads_by_ratio(base(spark, sf_dir)).select("cid")


@query("head_ratio_pruning", f"WITH n AS ({_nearest(8, '(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)')}) SELECT id AS qid, cid FROM (SELECT *, min(cd) OVER (PARTITION BY id) AS m FROM n) WHERE 1.1 * m <= 0.1 OR cd <= 1.1 * m")
def head_ratio_pruning(spark, sf_dir):
    return I.probes(stated_queries(spark, sf_dir), centroids(spark, sf_dir), 8, 1.1).select("qid", "cid")


@query("page_search", f"WITH k AS (SELECT DISTINCT qid, id // 8 AS page FROM ({S.KNN10}) WHERE rank <= 3), s AS (SELECT k.qid, e.vec_id AS id, {S.l2('e.embedding', 'q.embedding')} AS d FROM k JOIN embeddings e ON e.vec_id // 8 = k.page JOIN embeddings q ON q.vec_id = k.qid) SELECT qid, rank, id, d FROM ({S.top('SELECT * FROM s', 10)})")
def page_search(spark, sf_dir):
    """Every row on the pages of the three nearest is scored."""
    rows, queries = base(spark, sf_dir), stated_queries(spark, sf_dir)
    probed = knn(rows, queries, 3).select("qid", F.floor(F.col("id") / 8).alias("page")).distinct()
    paged = rows.withColumn("page", F.floor(F.col("id") / 8))
    scored = paged.join(probed, "page").join(queries, "qid").select("qid", "id", V.l2(F.col("v"), F.col("q")).alias("d"))
    return top_k(scored, 10).select("qid", "rank", "id", "d")


@query("entry_points", f"SELECT id AS qid, cid AS entry FROM ({_nearest(1, '(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)')})")
def entry_points(spark, sf_dir):
    return I.probes(stated_queries(spark, sf_dir), centroids(spark, sf_dir), 1).select("qid", F.col("cid").alias("entry"))


# --- graphs ---------------------------------------------------------------------------------

_GRAPH = f"SELECT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {S.l2('b.embedding', 'a.embedding')}, b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE n <= 5"


def _graph(spark, sf_dir):
    return G.knn_graph(base(spark, sf_dir), 5)


@query("knn_graph", _GRAPH)
def knn_graph(spark, sf_dir):
    """All rows against each other."""
    return _graph(spark, sf_dir).select("src", "dst")


_MERGED = f"""WITH m AS (SELECT vec_id AS id, embedding AS v, unnest([vec_id % 4, (vec_id + 1) % 4]) AS shard FROM embeddings),
    e AS (SELECT src, dst, min(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY shard, src ORDER BY d, dst) AS n FROM (SELECT a.shard, a.id AS src, b.id AS dst, {S.l2('b.v', 'a.v')} AS d FROM m a JOIN m b ON a.shard = b.shard AND a.id <> b.id)) WHERE n <= 6 GROUP BY src, dst)
    SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS n FROM e) WHERE n <= 8"""


@query("merged_shard_graph", _MERGED)
def merged_shard_graph(spark, sf_dir):
    """Four shards, each row in two of them, with graphs in local ids; merged by their id maps, eight edges a node at most."""
    rows = base(spark, sf_dir).select("id", "v", F.explode(F.array(F.col("id") % 4, (F.col("id") + 1) % 4)).alias("shard"))
    ids = settled(G.local_ids(rows))
    local = settled(rows.join(ids, ["shard", "id"]).select("shard", F.col("local").alias("id"), "v"))
    graphs = [G.knn_graph(local.where(F.col("shard") == i), 6).withColumn("shard", F.lit(i).cast("long")) for i in range(4)]
    both = graphs[0].unionByName(graphs[1]).unionByName(graphs[2]).unionByName(graphs[3])
    return G.merged_shard_graphs(both, ids, 8).select("src", "dst")


@query("undirected_graph", f"WITH g AS ({_GRAPH}) SELECT src, dst FROM g UNION SELECT dst, src FROM g")
def undirected_graph(spark, sf_dir):
    return G.both_ways(_graph(spark, sf_dir))


@query("degree_statistics", f"WITH g AS ({_GRAPH}), u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), d AS (SELECT src, count(*) AS n FROM u GROUP BY src) SELECT max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean FROM d")
def degree_statistics(spark, sf_dir):
    degrees = G.both_ways(_graph(spark, sf_dir)).groupBy("src").agg(F.count("*").alias("n"))
    return degrees.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"))


@query("breadth_first_levels", f"WITH RECURSIVE g AS ({_GRAPH}), w(id, level) AS (SELECT 0::bigint, 0 UNION SELECT g.dst, w.level + 1 FROM w JOIN g ON g.src = w.id WHERE w.level < 3) SELECT id, min(level) AS level FROM w GROUP BY id")
def breadth_first_levels(spark, sf_dir):
    start = spark.range(1).select(F.col("id"))
    return G.levels(_graph(spark, sf_dir).select("src", "dst"), start, 3)


@query("neighbourhood_within_radius", f"WITH RECURSIVE g AS ({_GRAPH}), near AS (SELECT g.* FROM g JOIN embeddings e ON e.vec_id = g.dst JOIN embeddings q ON q.vec_id = 0 WHERE {S.l2('e.embedding', 'q.embedding')} <= 1.6), w(id, level) AS (SELECT 0::bigint, 0 UNION SELECT near.dst, w.level + 1 FROM w JOIN near ON near.src = w.id WHERE w.level < 3) SELECT id, min(level) AS level FROM w GROUP BY id")
def neighbourhood_within_radius(spark, sf_dir):
    one = stated_queries(spark, sf_dir).where("qid = 0")
    near = scored_pairs(base(spark, sf_dir), one).where("d <= 1.6").select(F.col("id").alias("dst"))
    return G.levels(_graph(spark, sf_dir).join(near, "dst", "left_semi").select("src", "dst"), spark.range(1).select("id"), 3)


@query("page_overlap", f"WITH g AS ({_GRAPH}), c AS (SELECT src, count(*) AS c FROM g WHERE src // 8 = dst // 8 GROUP BY src), p AS (SELECT vec_id AS id, vec_id // 8 AS page, count(*) OVER (PARTITION BY vec_id // 8) AS n FROM embeddings) SELECT round(avg(CASE WHEN n > 1 THEN coalesce(c, 0) / (n - 1)::double ELSE 0 END), 9) AS overlap FROM p LEFT JOIN c ON c.src = p.id")
def page_overlap(spark, sf_dir):
    pages = base(spark, sf_dir).select("id", F.floor(F.col("id") / 8).alias("page"))
    return G.page_overlap(_graph(spark, sf_dir).select("src", "dst"), pages)


@query("visit_frequency", f"SELECT id, count(*) AS freq FROM ({S.KNN10}) GROUP BY id")
def visit_frequency(spark, sf_dir):
    """How often each row was among the results of the stated queries."""
    return knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 10).groupBy("id").agg(F.count("*").alias("freq"))


@query("frequent_nodes", f"WITH f AS (SELECT id, count(*) AS freq FROM ({S.KNN10}) GROUP BY id), r AS (SELECT id, freq, row_number() OVER (ORDER BY freq DESC, id) AS n, count(*) OVER () AS total FROM f) SELECT id, freq FROM r WHERE n <= floor(total * 0.1)")
def frequent_nodes(spark, sf_dir):
    """The most visited tenth; of equally visited nodes the smaller ids."""
    freq = visit_frequency(spark, sf_dir)
    n = freq.count() // 10
    return freq.orderBy(F.desc("freq"), "id").limit(n)


@query("reordered_adjacency", f"WITH g AS ({_GRAPH}), f AS (SELECT id, count(*) AS freq FROM ({S.KNN10}) GROUP BY id) SELECT src, list(dst ORDER BY coalesce(freq, 0) DESC, dst) AS nbrs FROM g LEFT JOIN f ON f.id = g.dst GROUP BY src")
def reordered_adjacency(spark, sf_dir):
    freq = visit_frequency(spark, sf_dir).withColumnRenamed("id", "dst")
    edges = _graph(spark, sf_dir).join(freq, "dst", "left")
    ordered = F.sort_array(F.collect_list(F.struct((-F.coalesce("freq", F.lit(0))).alias("f"), "dst")))
    return edges.groupBy("src").agg(F.transform(ordered, lambda e: e["dst"]).alias("nbrs"))


@query("medoid", f"WITH m AS (SELECT i, round(avg(x), 9) AS x FROM (SELECT unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i), c AS (SELECT list(x ORDER BY i) AS c FROM m) SELECT vec_id AS id FROM embeddings, c ORDER BY round({S.l2('embedding', 'c')}, 9), vec_id LIMIT 1")
def medoid(spark, sf_dir):
    return G.medoid(base(spark, sf_dir))


@query("medoid_per_label", f"WITH m AS (SELECT label, i, round(avg(x), 9) AS x FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label) SELECT label, id FROM (SELECT e.label, e.vec_id AS id, row_number() OVER (PARTITION BY e.label ORDER BY round({S.l2('e.embedding', 'c.c')}, 9), e.vec_id) AS n FROM embeddings e JOIN c ON e.label = c.label) WHERE n = 1")
def medoid_per_label(spark, sf_dir):
    return G.medoid(base(spark, sf_dir), "label")


@query("pruned_graph")
def pruned_graph(spark, sf_dir):
    rows = base(spark, sf_dir)
    return G.pruned(G.knn_graph(rows, 20), rows, 8)


@query("stitched_graph")
def stitched_graph(spark, sf_dir):
    return G.stitched(base(spark, sf_dir), 15, 8)


@query("grown_pages")
def grown_pages(spark, sf_dir):
    nodes = base(spark, sf_dir).select("id", F.lit(1).alias("freq"))
    return G.pages_by_growth(_graph(spark, sf_dir), nodes, 8)


def _searchable(spark, sf_dir):
    """Rows, stated queries, a pruned graph with its reverse edges, and seeds."""
    rows, queries = base(spark, sf_dir), stated_queries(spark, sf_dir)
    edges = settled(G.both_ways(G.pruned(G.knn_graph(rows, 20), rows, 8)))
    return rows, queries, edges, X.head_seeds(rows, queries)


@query("graph_beam_search")
def graph_beam_search(spark, sf_dir):
    """Best-first search of one graph by all queries at once, a round of joins for every eight expansions."""
    rows, queries, edges, seeds = _searchable(spark, sf_dir)
    return X.frontier_search(edges, rows, queries, seeds, 10, 60, 8)


@query("graph_search_with_max_check")
def graph_search_with_max_check(spark, sf_dir):
    """As above, but a query stops once 100 rows have been compared with it."""
    rows, queries, edges, seeds = _searchable(spark, sf_dir)
    return X.frontier_search(edges, rows, queries, seeds, 10, 60, 8, 100)


@query("resumed_graph_search")
def resumed_graph_search(spark, sf_dir):
    """A search of width 20 whose state is then deepened to 60: no row is expanded again."""
    rows, queries, edges, seeds = _searchable(spark, sf_dir)
    near = settled(X.neighbours(edges))
    first = X.deepen(X.start(rows, queries, seeds), rows, near, 20, 8)
    return X.nearest_of(X.deepen(first, rows, near, 60, 8), 10)


@query("inserted_graph")
def inserted_graph(spark, sf_dir):
    """The graph of a quarter of the rows, into which the others are inserted in two batches, the second twice as large."""
    rows = base(spark, sf_dir).select("id", "v")
    turn = F.pmod(F.xxhash64("id"), F.lit(4))
    return X.grow_graph(rows, turn == 0, F.when(turn == 1, 0).otherwise(1), 2, 10, 32, beam=8).select("src", "dst")


@query("two_hop_repair", f"WITH g AS ({_GRAPH}), kept AS (SELECT src, dst FROM g WHERE src % 10 <> 0 AND dst % 10 <> 0), hop AS (SELECT a.src, b.dst FROM g a JOIN g b ON a.dst = b.src WHERE a.dst % 10 = 0 AND a.src % 10 <> 0 AND b.dst % 10 <> 0 AND a.src <> b.dst) SELECT src, dst FROM kept UNION SELECT src, dst FROM hop")
def two_hop_repair(spark, sf_dir):
    from nearlake.operators.mutate import repaired_edges

    edges = settled(_graph(spark, sf_dir).select("src", "dst"))  # read three times
    return repaired_edges(edges, base(spark, sf_dir).where("id % 10 = 0").select("id"))
