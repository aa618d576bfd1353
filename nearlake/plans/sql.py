"""Pieces of the DuckDB oracles."""


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


def ip(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def norm2(a: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: x::double * x::double))"


def top(scored: str, k: int, group: str = "qid", order: str = "d, id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rank FROM ({scored})) WHERE rank <= {k}"


#: The stated queries and the base of most oracles.
QUERIES = "(SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0)"
BASE = "(SELECT vec_id AS id, embedding AS v, label FROM embeddings)"
SCORED = f"SELECT qid, id, {l2('v', 'q')} AS d FROM {BASE}, {QUERIES}"
KNN10 = f"SELECT qid, rank, id, d FROM ({top(SCORED, 10)})"
