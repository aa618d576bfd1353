"""A vector index as an object: building, searching, changing, saving."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlake.functions.vectors import METRICS
from nearlake.operators import frontier, inverted, knn, mutate
from nearlake.operators.tables import settled
from nearlake.operators.trees import select_heads

KINDS = ("exact", "inverted", "graph")


class VectorIndex:
    """Vectors (id, v and any other columns) with deletions, searched exactly, by inverted lists or over a graph.

    Every search returns a DataFrame; nothing is computed before it is read. A ``fixed`` index, one
    of lists that were laid out for good, refuses changes.
    """

    def __init__(self, rows: DataFrame, metric: str = "l2", kind: str = "exact", depth: int = 4, replicas: int = 2, degree: int = 16, width: int = 48, fixed: bool = False):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        if kind != "exact" and metric != "l2":
            raise ValueError("inverted lists and graphs rank by squared distance alone")
        missing = {"id", "v"} - set(rows.columns)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        if depth < 0 or replicas < 1 or not 1 <= degree <= width:
            raise ValueError("depth and replicas must be positive, degree positive and at most the width")
        self.rows, self.metric, self.kind, self.depth, self.replicas, self.fixed = rows, metric, kind, depth, replicas, fixed
        self.degree, self.width = degree, width
        self.deleted = rows.select("id").limit(0)
        self._edges: DataFrame | None = None
        self._lists: tuple[DataFrame, DataFrame] | None = None

    @property
    def active(self) -> DataFrame:
        return mutate.active(self.rows, self.deleted)

    def _inverted(self) -> tuple[DataFrame, DataFrame]:
        if self._lists is None:
            heads = select_heads(self.rows, self.depth)
            self._lists = heads, inverted.postings(self.rows, heads, self.replicas).persist()
        return self._lists

    def _graph(self) -> DataFrame:
        """Edges (src, dst, d) over all rows, the deleted ones, too, until they are consolidated."""
        if self._edges is None:
            self._edges = frontier.built_graph(self.rows.where("v IS NOT NULL"), self.degree, self.width)
        return self._edges

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int = 4, with_deleted: bool = False) -> DataFrame:
        """(qid, rank, id, d) for queries (qid, q). A condition holds before the ranking.

        k rows come back whenever k exist: a query that finds fewer in the lists that it probes or among the rows that
        its walk over the graph meets, as with a selective condition or many deleted rows, is ranked against all rows that hold.
        A walk goes through rows that don't hold.
        """
        if k < 1 or probes < 1:
            raise ValueError("k and probes must be positive")
        rows = self.rows if with_deleted else self.active
        if where is not None:
            rows = rows.where(where)
        if self.kind == "exact":
            return knn.knn(rows.select("id", "v"), queries, k, self.metric)
        queries = queries.select("qid", "q")
        if self.kind == "graph":
            found = settled(self._walk(rows, queries, k))
        else:
            found = settled(self._probe(rows, queries, k, probes, with_deleted and where is None))
        # a query has k rows if it has one of rank k
        lacking = queries.join(found.where(F.col("rank") == k).select("qid"), "qid", "left_anti")
        exact = knn.knn(rows.select("id", "v"), lacking, k)
        return found.join(lacking.select("qid"), "qid", "left_anti").select("qid", "rank", "id", "d").unionByName(exact)

    def _walk(self, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        every = self.rows.select("id", "v")
        width = max(self.width, k)
        state = frontier.deepen(frontier.start(every, queries, frontier.head_seeds(every, queries)), every, settled(frontier.neighbours(self._graph())), width)
        met = state.select("qid", F.explode("scored").alias("x")).select("qid", "x.id", "x.d").join(rows.select("id"), "id", "left_semi")
        return knn.top_k(met, k).select("qid", "rank", "id", "d")

    def _probe(self, rows: DataFrame, queries: DataFrame, k: int, probes: int, every: bool) -> DataFrame:
        heads, lists = self._inverted()
        held = lists if every else lists.join(rows.select("id"), "id", "left_semi")
        return inverted.search(rows, held, inverted.probes(queries, heads, probes), queries, k, self.replicas).select("qid", "rank", "id", "d")

    def search_with_tags(self, queries: DataFrame, k: int, with_vectors: bool = False, **options) -> DataFrame:
        """As ``search``, with the rows' tags in place of their ids, and their vectors if wanted. Rows have a column tag."""
        if "tag" not in self.rows.columns:
            raise ValueError("the rows have no tags")
        found = self.search(queries, k, **options)
        return found.join(self.rows.select("id", "tag", *(["v"] if with_vectors else [])), "id").drop("id")

    def within(self, queries: DataFrame, radius: float) -> DataFrame:
        return knn.within(self.active.select("id", "v"), queries, radius, self.metric)

    def _check_open(self) -> None:
        if self.fixed:
            raise ValueError("a fixed index can't be changed")

    def insert(self, new: DataFrame) -> DataFrame:
        """Adds rows; returns those refused (id 0, null, known or repeated)."""
        self._check_open()
        before = self.rows
        self.rows, refused = mutate.insert(self.rows, new)
        self._lists = None
        if self._edges is not None:  # the new rows walk the graph as it is and are linked into it
            fresh = settled(self.rows.join(before.select("id"), "id", "left_anti").where("v IS NOT NULL").select("id", "v"))
            old = before.select("id", "v")
            seeds = frontier.head_seeds(old, fresh.toDF("qid", "q"))
            self._edges = frontier.insert_batch(self._edges, old, fresh, seeds, self.degree, self.width)
        return refused

    def delete(self, ids: DataFrame) -> DataFrame:
        """Marks rows as deleted; returns the ids that aren't there."""
        self._check_open()
        self.deleted, failed = mutate.lazy_delete(self.rows, self.deleted, ids)
        return failed

    def consolidate(self) -> DataFrame:
        """Drops the deleted rows; returns a report."""
        self._check_open()
        gone = settled(self.deleted)
        self.rows, report = mutate.consolidate(self.rows, gone)
        if self._edges is not None:
            self._edges = frontier.without(self._edges, self.rows, gone, self.degree)
        self.deleted, self._lists = self.rows.select("id").limit(0), None
        return report

    def merge(self, other: VectorIndex) -> VectorIndex:
        """A new index over both; the other's ids go on from this one's largest."""
        return VectorIndex(mutate.merge_tables(self.active, other.active), self.metric, self.kind, self.depth, self.replicas, self.degree, self.width)

    def vector(self, id: int) -> DataFrame:
        return self.active.where(F.col("id") == id).select("id", "v")

    def save(self, path: str) -> None:
        """Rows, deletions, settings and heads and lists of an inverted index, edges of a graph, as Parquet tables in a folder."""
        self.rows.write.parquet(f"{path}/rows")
        self.deleted.write.parquet(f"{path}/deleted")
        if self.kind == "inverted":
            heads, lists = self._inverted()
            heads.write.parquet(f"{path}/heads")
            lists.write.parquet(f"{path}/lists")
        if self.kind == "graph":
            self._graph().write.parquet(f"{path}/edges")
        settings = json.dumps({"metric": self.metric, "kind": self.kind, "depth": self.depth, "replicas": self.replicas, "degree": self.degree, "width": self.width, "fixed": self.fixed})
        self.rows.sparkSession.createDataFrame([(settings,)], "settings string").coalesce(1).write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        settings = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
        index = cls(spark.read.parquet(f"{path}/rows"), **settings)
        index.deleted = spark.read.parquet(f"{path}/deleted")
        if index.kind == "inverted":  # as it was built; nothing is trained again
            index._lists = spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/lists")
        if index.kind == "graph":
            index._edges = spark.read.parquet(f"{path}/edges")
        return index
