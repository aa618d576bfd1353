import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from nearlake.llm.common import WORD
from nearlake.llm.components import connected_components
from nearlake.llm.near_duplicates import near_duplicates, one_of_each, plan_bands

from .conftest import edge_rows, prose


def brute(rows, threshold=0.8):
    """Links counted pair by pair, and components, over rows (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = re.findall(WORD, text or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc_id)
    return sorted((doc_id, least[find(i)], links[i]) for i, (doc_id, _) in enumerate(rows))


def family(r, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(changes):
            words[r.randrange(len(words))] = "new" + str(r.randrange(10**6))
        out.append(" ".join(words))
    return out


def corpus():
    r = random.Random(4)
    texts = [prose(100 + i, 80 + i) for i in range(30)]
    texts += family(r, prose(1, 200), 40, 2) + family(r, prose(2, 120), 25, 4) + [prose(3, 90)] * 12 + family(r, prose(1, 200), 10, 9)
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 8])
def test_same_as_all_pairs(spark, block):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = plan_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        plan_bands(0.1, 0.999999, 8)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 140)}}


def test_edges(edges, empty):
    got = near_duplicates(edges).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute([r[:2] for r in edge_rows()])
    kept = one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute([r[:2] for r in edge_rows()])})
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_equal_ids_with_other_texts(spark):
    """Rows are told apart by their texts: unrelated classes don't merge through an id that repeats, and none is lost."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (2, a), (3, b), (3, c), (4, c), (None, a), (None, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in near_duplicates(docs).collect())
    assert got == sorted([(1, 1, 2), (1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 3, 1), (4, 3, 1), (-1, 1, 2), (-1, -1, 0), (5, 5, 0)])
    kept = sorted(((r.doc_id or -1), r.text) for r in one_of_each(docs).where("text is not null").collect())
    assert kept == sorted([(1, a), (1, b), (3, c)])


def test_equal_rows(spark):
    """Of rows equal in all columns one stays, but for texts without shingles and ids, which all stay."""
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a)] * 3 + [(2, a)] + [(None, b)] * 2 + [(None, None)] * 3 + [(None, " ")] + [(5, "")] * 2 + [(5, None)]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, (r.text or "").strip()) for r in out) == {(1, a): 1, (None, b): 1, (None, ""): 4, (5, ""): 1}


def test_columns_of_any_type_and_name(spark):
    rows = [(i, prose(1 if i < 3 else i, 60), {"k": i}, [{"z": 1}], i, "h", 7) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, more array<map<string,int>>, row int, hash string, `a.b` int")
    out = one_of_each(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [rows[0], rows[3], rows[4]]


def test_recall_on_documents(spark):
    """All pairs of real documents at 0.8 or more, found by an index of all shingles, are in one class; no other text is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = {d: (c, n) for d, c, n in by_index(rows)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert got == want


def by_index(rows, threshold=0.8):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(WORD, text or "")
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for doc_id, s in sets.items():
        for g in s:
            holders[g].append(doc_id)
    common = Counter()
    for ids in holders.values():
        common.update(combinations(ids, 2))
    links, root = Counter(), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, find(d), links[d]) for d in sets]
