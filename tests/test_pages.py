import random

from nearlake.operators.graph import heavy_edge_pages


def in_one_order(edges, capacity):
    page = {x: x for e in edges for x in e[:2]}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = sorted((page[a], page[b]))
        if a != b and sum(p in (a, b) for p in page.values()) <= capacity:
            page = {x: a if p == b else p for x, p in page.items()}
    return page


def test_heavy_edges_join_pages_across_parts(spark):
    r = random.Random(1)
    edges = [(a, b, r.randrange(1, 9) / 4) for a in range(40) for b in r.sample(range(40), 4) if a != b]
    got = heavy_edge_pages(spark.createDataFrame(edges, "src long, dst long, w double").repartition(3), 5)
    assert dict(got.collect()) == in_one_order(edges, 5)
