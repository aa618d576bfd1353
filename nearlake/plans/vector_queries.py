"""Named queries on vector expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nearlake.functions import vectors as V
from nearlake.operators import pairs as P
from nearlake.operators.knn import all_pairs, pairs_below
from nearlake.plans import sql as S
from nearlake.plans.inputs import base, stated_queries
from nearlake.plans.registry import query

_PAIRS = f"{S.BASE}, {S.QUERIES}"


def _distance(name: str, method: str, sql: str, digits: int | None = None) -> None:
    """A distance of each stated query to each base vector: one row each. With ``digits``, its rounded absolute value."""

    @query(name, f"SELECT qid, id, {sql} AS d FROM {_PAIRS} ")
    def run(spark, sf_dir):
        exact = P.METHODS[method].exact
        how = P.Method(exact) if digits is None else P.Method(lambda v, q, every: np.abs(P.rounded(exact(v, q, every), digits)))
        return all_pairs(base(spark, sf_dir), stated_queries(spark, sf_dir), how)


_COS = f"(1 - {S.ip('v', 'q')} / (sqrt({S.norm2('v')}) * sqrt({S.norm2('q')})))"
_distance("distance_l2", "l2", S.l2("v", "q"))
_distance("distance_inner_product", "inner_product", f"-({S.ip('v', 'q')})")
_distance("distance_cosine", "cosine", f"abs(round({_COS}, 9))", 9)
_distance("distance_cosine_of_units", "cosine_of_units", f"abs(round(2 * {_COS}, 9))", 9)
_distance("distance_fast_l2", "fast_l2", f"{S.norm2('v')} - 2 * {S.ip('v', 'q')}")
_distance("distance_euclidean", "euclidean", f"round(sqrt({S.l2('v', 'q')}), 9)", 9)
_distance("similarity_from_distance", "similarity", f"1 - {S.l2('v', 'q')}")


def _row(name: str, columns, sql: dict[str, str]) -> None:
    """A query with a row per embedding: ``columns`` makes named expressions of the vector column."""

    @query(name, "SELECT vec_id AS id, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + " FROM embeddings")
    def run(spark, sf_dir):
        return base(spark, sf_dir).select("id", *(e.alias(c) for c, e in columns(F.col("v")).items()))


def _rounded(v):
    return F.transform(v, lambda x: V.rounded(x, 9))


def _rounded_sql(v: str, f: str) -> str:
    return f"list_transform({v}, lambda x: round({f}, 9))"


_row("squared_norm", lambda v: {"n": V.squared_norm(v)}, {"n": S.norm2("embedding")})
_row("normalize_with_epsilon", lambda v: {"u": _rounded(V.normalized(v, 1e-6))}, {"u": _rounded_sql("embedding", f"x::double / sqrt({S.norm2('embedding')} + 1e-6)")})
_row("normalize", lambda v: {"u": _rounded(V.normalized(v))}, {"u": _rounded_sql("embedding", f"x::double / sqrt({S.norm2('embedding')})")})
_row("normalize_to_base", lambda v: {"u": _rounded(V.normalized_to(v, 127.0))}, {"u": _rounded_sql("embedding", f"x::double / sqrt({S.norm2('embedding')}) * 127.0")})
_row("query_for_inner_product", lambda v: {"u": _rounded(V.augmented_query(v))}, {"u": f"list_append({_rounded_sql('embedding', f'x::double / sqrt({S.norm2("embedding")})')}, 0.0::double)"})
_row("float_to_int8", lambda v: {"codes": F.transform(V.doubles(v), lambda x: ((x - 0.1) * 254 / 2.0).cast("int"))}, {"codes": "list_transform(embedding, lambda x: trunc((x::double - 0.1) * 254 / 2.0)::int)"})
_row("int8_to_float", lambda v: {"u": F.transform(F.transform(V.doubles(v), lambda x: (x * 127).cast("int")), lambda c: c / F.lit(127.0))}, {"u": "list_transform(embedding, lambda x: trunc(x::double * 127)::int / 127.0::double)"})
_row("bytes_to_unit_floats", lambda v: {"u": F.transform(V.doubles(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x * 128 + 128).cast("int"))) / F.lit(255.0))}, {"u": "list_transform(embedding, lambda x: greatest(0, least(255, trunc(x::double * 128 + 128)::int)) / 255.0::double)"})
_row("segment_means", lambda v: {f"m{i}": F.round(V.mean(V.part(v, 16 * i, 16)), 9) for i in range(4)}, {f"m{i}": f"round(list_sum(list_transform(embedding[{16 * i + 1}:{16 * i + 16}], lambda x: x::double)) / 16, 9)" for i in range(4)})
_DEV = "round(sqrt(list_sum(list_transform({s}, lambda x: (x::double - list_sum(list_transform({s}, lambda y: y::double)) / 16) * (x::double - list_sum(list_transform({s}, lambda y: y::double)) / 16))) / 16), 9)"
_row("segment_deviations", lambda v: {f"s{i}": F.round(V.deviation(V.part(v, 16 * i, 16)), 9) for i in range(4)}, {f"s{i}": _DEV.format(s=f"embedding[{16 * i + 1}:{16 * i + 16}]") for i in range(4)})
#: A fixed orthogonal matrix: a rotation by 0.6/0.8 in the first two of four coordinates, the others swapped.
ROTATION = [[0.6, -0.8, 0.0, 0.0], [0.8, 0.6, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 1.0, 0.0]]
#: The same in each run of four of 64 coordinates: every vector is rotated whole.
_TURNS = [(4 * block, f"r{4 * block + i}", row) for block in range(16) for i, row in enumerate(ROTATION)]
_row("rotate", lambda v: {r: V.matrix_times([row], V.part(v, at, 4))[0] for at, r, row in _TURNS}, {r: S.ip(f"embedding[{at + 1}:{at + 4}]", f"[{', '.join(f'{x}::double' for x in row)}]") for at, r, row in _TURNS})
_row("full_precision_codes", lambda v: {"v": v}, {"v": "embedding"})
_row("vector_text", lambda v: {"line": F.concat(F.col("id").cast("string"), F.lit("\t"), F.array_join(F.transform(V.doubles(v), lambda x: F.round(x * 1000).cast("int").cast("string")), "|"))}, {"line": "vec_id::varchar || chr(9) || array_to_string(list_transform(embedding, lambda x: round(x::double * 1000)::int::varchar), '|')"})


@query("augment_for_inner_product", f"""
    WITH m AS (SELECT sqrt(max({S.norm2('embedding')})) AS m FROM embeddings)
    SELECT vec_id AS id, list_append(list_transform(embedding, lambda x: round(x::double / m, 7)),
           round(sqrt(greatest(0.0, 1 - {S.norm2('embedding')} / (m * m))), 3)) AS u FROM embeddings, m""")
def augment_for_inner_product(spark, sf_dir):
    rows = base(spark, sf_dir)
    largest = rows.agg(F.sqrt(F.max(V.squared_norm(F.col("v")))).alias("m"))
    u = V.augmented(F.col("v"), F.col("m"))
    # the last coordinate is the root of a difference near zero, so few of its digits are certain
    return rows.crossJoin(F.broadcast(largest)).select(
        "id", F.concat(F.transform(F.slice(u, 1, F.size(u) - 1), lambda x: V.rounded(x, 7)), F.array(V.rounded(F.element_at(u, -1), 3))).alias("u")
    )


@query("hamming_of_signs", """
    WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM embeddings)
    SELECT a.id AS qid, b.id, len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) AS d FROM s a, s b WHERE a.id % 20 = 0""")
def hamming_of_signs(spark, sf_dir):
    signs = base(spark, sf_dir).select("id", F.transform("v", lambda x: F.when(x > 0, 1).otherwise(0)).alias("v"))
    queries = signs.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return all_pairs(signs, queries, P.METHODS["hamming"], "int")


@query("jaccard_of_large_coordinates", """
    WITH s AS (SELECT vec_id AS id, list_filter(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0.15 THEN i END), lambda i: i IS NOT NULL) AS s FROM embeddings),
    p AS (SELECT a.id AS qid, b.id, len(list_intersect(a.s, b.s)) AS common, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS one FROM s a, s b WHERE a.id % 20 = 0)
    SELECT qid, id, CASE WHEN one > 0 THEN 1 - common / one::double ELSE 0.0 END AS d FROM p
    WHERE CASE WHEN one > 0 THEN 1 - common / one::double ELSE 0.0 END < 1 - 1e-5""")
def jaccard_of_large_coordinates(spark, sf_dir):
    # a float compares with a float, as in the SQL: the one next to 0.15 isn't above it; nor is what isn't there, of a null vector too
    large = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("v", i) > F.lit(0.15).cast("float"), 1).otherwise(0).cast("tinyint"))
    sets = base(spark, sf_dir).select("id", large.alias("v"))
    queries = sets.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return pairs_below(sets, queries, P.Method(P.shared_places), 1 - 1e-5)


@query("base64_round_trip", "SELECT event_id, base64(props::blob) AS encoded, props AS decoded FROM events")
def base64_round_trip(spark, sf_dir):
    from nearlake.plans.registry import table

    encoded = F.base64(F.col("props").cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", F.translate(encoded, "\r\n", "").alias("encoded"), F.unbase64(encoded).cast("string").alias("decoded"))


@query("json_request", f"""
    SELECT qid, '{{"query_id":' || qid || ',"k":10,"ids":[' || string_agg(id::varchar, ',' ORDER BY rank) || ']}}' AS response FROM ({S.KNN10}) GROUP BY qid""")
def json_request(spark, sf_dir):
    from nearlake.operators.knn import knn

    found = knn(base(spark, sf_dir), stated_queries(spark, sf_dir), 10).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("r"))
    body = F.to_json(F.struct(F.col("qid").alias("query_id"), F.lit(10).alias("k"), F.transform("r", lambda r: r["id"]).alias("ids")))
    return found.select("qid", body.alias("response"))
