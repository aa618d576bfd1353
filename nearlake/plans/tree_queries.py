"""Named queries on trees, budgets and settings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.vectors import l2
from nearlake.operators import graph as G
from nearlake.operators import inverted as I
from nearlake.operators import trees as T
from nearlake.operators.knn import knn, knn_by_group
from nearlake.operators.measures import recall
from nearlake.operators.tables import settled
from nearlake.plans import sql as S
from nearlake.plans.inputs import base, centroids, stated_queries
from nearlake.plans.registry import query, table
from nearlake.plans.structure_queries import _graph, _nearest
from nearlake.streaming.updates import apply_changes, slide

_SPLIT = """SELECT n.id, n.v, 2 * n.node + CASE WHEN n.v[s.i]::double < s.mean THEN 0 ELSE 1 END AS node FROM {t} n JOIN
    (SELECT node, i, mean FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY var DESC, i) AS r FROM (SELECT node, i, round(var_pop(x), 9) AS var, round(avg(x), 9) AS mean FROM
    (SELECT node, unnest(v)::double AS x, generate_subscripts(v, 1) AS i FROM {t}) GROUP BY node, i)) WHERE r = 1) s ON s.node = n.node"""
_TREE = f"t0 AS (SELECT vec_id AS id, embedding AS v, 1::bigint AS node FROM embeddings), t1 AS ({_SPLIT.format(t='t0')}), t2 AS ({_SPLIT.format(t='t1')}), t3 AS ({_SPLIT.format(t='t2')})"


def _tree(spark, sf_dir):
    return T.kd_tree(base(spark, sf_dir).select("id", "v"), 3)


@query("kd_tree_leaves", f"WITH {_TREE} SELECT id, node FROM t3")
def kd_tree_leaves(spark, sf_dir):
    return _tree(spark, sf_dir).select("id", "node")


_BOXES = "b AS (SELECT node, i, min(x) AS lo, max(x) AS hi FROM (SELECT node, unnest(v)::double AS x, generate_subscripts(v, 1) AS i FROM t3) GROUP BY node, i)"
_BOUNDS = "c AS (SELECT q.vec_id AS qid, b.node, round(sum(greatest(lo - q.embedding[i]::double, q.embedding[i]::double - hi, 0.0) * greatest(lo - q.embedding[i]::double, q.embedding[i]::double - hi, 0.0)), 9) AS bound FROM embeddings q, b WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, b.node)"


@query("leaf_routing", f"WITH {_TREE}, {_BOXES}, {_BOUNDS} SELECT qid, node, bound FROM c")
def leaf_routing(spark, sf_dir):
    """Lower bounds of all leaves, in whose order a search visits them."""
    routed = T.route(stated_queries(spark, sf_dir), T.boxes(_tree(spark, sf_dir)), 8)
    return routed.select("qid", "node", F.round("bound", 9).alias("bound"))


@query("tree_search")
def tree_search(spark, sf_dir):
    """Exact ranking within the four leaves of the least bounds."""
    leaves, queries = settled(_tree(spark, sf_dir)), stated_queries(spark, sf_dir)
    probed = settled(T.route(queries, T.boxes(leaves), 4))
    return T.search_leaves(leaves, probed, queries, 10)


@query("selected_heads")
def selected_heads(spark, sf_dir):
    return T.select_heads(base(spark, sf_dir), 4).select("cid")


def _recall_sql(n: int) -> str:
    probes = f"p{n} AS (SELECT id AS qid, cid FROM ({_nearest(n, '(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)')}))"
    found = f"f{n} AS (SELECT c.qid, c.id, {S.l2('e.embedding', 'q.embedding')} AS d FROM (SELECT DISTINCT p.qid, l.id FROM p{n} p JOIN lists l USING (cid)) c JOIN embeddings e ON e.vec_id = c.id JOIN embeddings q ON q.vec_id = c.qid)"
    return f"{probes}, {found}, r{n} AS (SELECT {n} AS probes, count(*) AS hits FROM truth JOIN (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM f{n}) r USING (qid, id) WHERE r.rank <= 10)"


@query("recall_by_probes", f"WITH lists AS (SELECT cid, id FROM ({_nearest(1)})), truth AS (SELECT qid, id FROM ({S.KNN10})), {_recall_sql(1)}, {_recall_sql(3)} SELECT probes, hits, round(100.0 * hits / (SELECT count(DISTINCT qid) * 10 FROM truth), 6)::double AS recall FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r3)")
def recall_by_probes(spark, sf_dir):
    """A grid of settings: lists probed and the recall they give."""
    rows, heads, queries = base(spark, sf_dir), centroids(spark, sf_dir), stated_queries(spark, sf_dir)
    truth, lists = knn(rows, queries, 10), I.postings(rows, heads, 1)
    runs = [recall(truth, I.search(rows, lists, I.probes(queries, heads, n), queries, 10), 10, ties=False).select(F.lit(n).alias("probes"), "hits", "recall") for n in (1, 3)]
    return runs[0].unionByName(runs[1])


def _grid_sql() -> str:
    parts, runs = [f"truth AS (SELECT qid, id FROM ({S.KNN10}))"], []
    for r in (1, 2):
        parts.append(f"l{r} AS (SELECT cid, id FROM ({_nearest(r)}))")
        for n in (1, 2, 4):
            parts.append(f"p{r}{n} AS (SELECT id AS qid, cid FROM ({_nearest(n, '(SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0)')}))")
            parts.append(f"f{r}{n} AS (SELECT c.qid, c.id, {S.l2('e.embedding', 'q.embedding')} AS d FROM (SELECT DISTINCT p.qid, l.id FROM p{r}{n} p JOIN l{r} l USING (cid)) c JOIN embeddings e ON e.vec_id = c.id JOIN embeddings q ON q.vec_id = c.qid)")
            runs.append(f"SELECT {r} AS replicas, {n} AS probes, (SELECT count(*) FROM truth JOIN (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM f{r}{n}) x USING (qid, id) WHERE x.rank <= 10) AS hits, (SELECT count(*) FROM f{r}{n}) AS scored")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(runs)}"


@query("recall_grid", _grid_sql())
def recall_grid(spark, sf_dir):
    """Six settings of replicas and probes: hits among the ten nearest, and rows scored for them."""
    rows, heads, queries = base(spark, sf_dir), centroids(spark, sf_dir), stated_queries(spark, sf_dir)
    truth = settled(knn(rows, queries, 10).select("qid", "id"))
    probed = settled(I.probes(queries, heads, 4).withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("hd", "cid"))))
    runs = []
    for r in (1, 2):
        lists = settled(I.postings(rows, heads, r))
        asked = lists.select("cid", "id", "v").join(probed.join(queries.select("qid", "q"), "qid"), "cid")
        # all numbers of probes at once: a row found by the n-th probe is there for n and more
        met = asked.groupBy("qid", "id").agg(F.min("n").alias("n"), F.min(l2(F.col("v"), F.col("q"))).alias("d"))
        each = met.select("qid", "id", "d", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda p: p >= F.col("n"))).alias("probes"))
        ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("qid", "probes").orderBy("d", "id")))
        hit = F.when(F.col("rank") <= 10, F.col("true"))
        marked = ranked.join(truth.withColumn("true", F.lit(1)), ["qid", "id"], "left")
        runs.append(marked.groupBy("probes").agg(F.count(hit).alias("hits"), F.count("*").alias("scored")).select(F.lit(r).alias("replicas"), "probes", "hits", "scored"))
    return runs[0].unionByName(runs[1])


@query("greedy_pages")
def greedy_pages(spark, sf_dir):
    return G.pages_by_votes(_graph(spark, sf_dir), base(spark, sf_dir).select("id"), 8, 4)


@query("heavy_edge_pages")
def heavy_edge_pages(spark, sf_dir):
    return G.heavy_edge_pages(_graph(spark, sf_dir).withColumn("w", 1 / (1 + F.col("d"))), 8)


_SHARD_RECALL = f"WITH t AS ({S.KNN10}), f AS (SELECT qid, id, id % 4 AS shard FROM ({S.top(S.SCORED + ' WHERE id % 5 <> 0', 10, 'qid, id % 4')})) SELECT t.id % 4 AS shard, count(*) AS wanted, count(f.id) AS found FROM t LEFT JOIN f ON f.qid = t.qid AND f.id = t.id AND f.shard = t.id % 4 GROUP BY t.id % 4"


@query("recall_of_shards", _SHARD_RECALL)
def recall_of_shards(spark, sf_dir):
    """What each of four shards, searched without a fifth of the base, finds of the true neighbours that it holds."""
    rows, queries = base(spark, sf_dir), stated_queries(spark, sf_dir)
    truth = knn(rows, queries, 10).select("qid", "id", (F.col("id") % 4).alias("shard"))
    searched = knn_by_group(rows.where("id % 5 <> 0").withColumn("shard", F.col("id") % 4), queries, 10, "shard")
    found = searched.select("qid", "id", "shard", F.lit(1).alias("hit"))
    return truth.join(found, ["qid", "id", "shard"], "left").groupBy("shard").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


@query("sliding_steps", "SELECT step, count(*) AS n FROM range(0, (SELECT count(*) // 50 FROM embeddings)) s(step), embeddings WHERE vec_id < step * 50 + 50 AND vec_id >= CASE WHEN step * 50 >= 200 THEN step * 50 - 150 ELSE 0 END GROUP BY step")
def sliding_steps(spark, sf_dir):
    arrivals = base(spark, sf_dir).select("id", F.col("id").alias("seq"))
    alive = slide(arrivals, 150, 50).where(F.col("step") < arrivals.count() // 50)
    # rows that came before the window was full stay until the first delete
    return alive.groupBy("step").agg(F.count("*").alias("n"))


@query("changed_rows", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0")
def changed_rows(spark, sf_dir):
    rows = base(spark, sf_dir)
    inserts = rows.where("id % 2 = 1").select(F.col("id").alias("seq"), F.lit("insert").alias("op"), "id", "v")
    deletes = rows.where("id % 6 = 3").select((F.col("id") + rows.count()).alias("seq"), F.lit("delete").alias("op"), "id", "v")
    return apply_changes(rows.where("id % 2 = 0"), inserts.unionByName(deletes)).select("id")


@query("nation_customers", "SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_customers(spark, sf_dir):
    """A relational check on the star schema: join, group, sum."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
