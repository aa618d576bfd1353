"""Line dedup, vector codes and periodic runs against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from nearlake.llm import line_dedup, periodic_runs, vector_codes
from nearlake.llm.queries import LLM_ORACLES, LLM_QUERIES

from .conftest import prose

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label string, error string, codes int"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in want.description]
    got = LLM_QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# --- lines ----------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDS = "doc_id long, text string, row string, words int, h1 double"


def deduped(rows):
    """(doc_id, n_lines, n_dropped, text) of each row, by a table of first documents."""
    docs = [((1 << 63) - 1 if r[0] is None else r[0], r[0], (r[1] or "").split("\n")) for r in rows]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first, last = {}, {}
    for doc, _, lines in docs:
        for x in map(key, lines):
            first[x], last[x] = min(first.get(x, doc), doc), max(last.get(x, doc), doc)
    out = []
    for doc, doc_id, lines in docs:
        kept = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] < last[key(x)] and doc > first[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def shared_lines():
    r = random.Random(3)
    pool = [prose(i, r.randint(1, 9)).replace("\n", " ") for i in range(60)] + ["ÄÖÜ äöü Ünïcode", "K" * 12, "k" * 12, "K" * 12, "  tabs and CASE \t\r", "TABS and case", "nine char", "ten chars!"]
    rows = [(i, "\n".join(r.choice(pool) + r.choice(["", " ", "\x0b", " "]) for _ in range(r.choice([0, 1, 3, 20, 200])))) for i in range(120)]
    return rows + [(7, "a line that only seven has\nsecond"), (7, "a line that only seven has\nthird"), (None, rows[3][1]), (None, pool[0]), (-5, pool[1] + "\n\n"), (9, None), (10, "")]


def test_lines_against_a_table_of_first_documents(spark):
    rows = shared_lines()
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], FOLDS).repartition(5)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == deduped(rows)


def test_a_line_of_every_document_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", 50)
    rows = [(i, f"the line that all documents have\n{prose(i, 12)}\n" + "the line that all documents have\n" * (i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    often, tasks = line_dedup.frequent_keys(line_dedup.numbered(docs))
    assert tasks > 10 and often.orderBy("parts").collect()[-1].parts > 4
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(docs).collect()), key=repr) == deduped(rows)


def test_bitmaps_hold_the_lines_that_stay(spark):
    lines = [f"line number {i} of the text" for i in range(300)]
    rows = [(1, "\n".join(lines[100:103] + lines[299:])), (2, "\n".join(lines))]
    found = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 1 and found[0].n_dropped == 4
    gone = {64 * w.word + i for w in found[0]["words"] for i in range(64) if not w.keep >> i & 1}
    assert gone == {100, 101, 102, 299} and len(found[0]["words"]) == 2


def test_lines_of_odd_rows(spark, edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert sorted((tuple(r) for r in line_dedup.dedup_lines(edges).collect()), key=repr) == deduped(rows)
    assert line_dedup.dedup_digests(empty).collect() == []
    got = {r.doc_id: r for r in line_dedup.dedup_digests(edges).collect()}
    assert got[0].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[0].n_lines == 1 and got[0].n_dropped == 0


# --- vectors --------------------------------------------------------------------------------


def coded(rows, parts=16, entries=64, rounds=2):
    """Codes and errors by looking at every entry, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // parts
    piece = lambda v, p: v[p * w : (p + 1) * w]
    books = [[piece(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((square(piece(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for p in range(parts):
                own = sums.setdefault((p, nearest(v, p)[1]), [0, [0] * w])
                own[0] += 1
                own[1] = [x + y for x, y in zip(own[1], piece(v, p))]
        for (p, k), (n, total) in sums.items():
            books[p][k] = [x // n for x in total]
    found = [(i, label, [nearest(v, p) for p in range(parts)]) for i, v, label in kept]
    labels = Counter()
    for _, label, near in found:
        labels[label] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), labels[label], digest) for i, label, near in found), key=repr)


def vectors(n=300, width=32, seed=5):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(8, width))
    rows = [(int(i), [float(x) for x in np.round(centers[i % 8] + r.normal(size=width) * r.choice([0, 0.02, 0.3]), 3)], [None, "a", "b"][i % 3], "e", 1) for i in r.permutation(n)]
    odd = [(1000, None), (1001, [None] + [0.0] * (width - 1)), (1002, [float("nan")] * width), (1003, [float("-inf")] + [1.0] * (width - 1)), (None, [0.5] * width), (None, [0.25] * width)]
    return rows + [(*x, "a", "e", 1) for x in odd] + rows[:5]


def test_codes_against_all_entries(spark):
    for rows in (vectors(), vectors(20, 16, 6)):
        got = vector_codes.code_digests(spark.createDataFrame(rows, VECTORS).repartition(3))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows)


def test_many_labels_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    rows = vectors(90)
    got = vector_codes.code_digests(spark.createDataFrame(rows, VECTORS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows)


def test_exponion_search_finds_the_first_nearest_entry():
    r = np.random.default_rng(1)
    for _ in range(200):
        top, n, size, parts = r.choice([2, 4, 50, 1000]), int(r.integers(1, 65)), int(r.integers(1, 5)), int(r.integers(1, 4))
        entries, x = r.integers(-top, top, (parts, n, size)), r.integers(-top, top, (100, parts, size))
        code, d = vector_codes.Codebooks(entries).nearest(x, r.integers(0, n, (100, parts)))
        every = ((x[:, :, None, :] - entries[None]) ** 2).sum(-1)
        assert (code == every.argmin(2)).all() and (d == every.min(2)).all()


def test_vectors_of_odd_shapes(spark):
    rows = [(3, [1e300] * 16), (4, [0.0] * 16), (5, [0.0] * 17), (6, []), (2, [0.0] * 3), (7, [-1e300] * 16)]
    got = vector_codes.code_digests(spark.createDataFrame([(*x, "a", "e", 1) for x in rows], VECTORS)).collect()
    assert sorted(r.vec_id for r in got) == [3, 4, 7] and all(r.error == 0 for r in got)
    for none in ([], [(1, None, "a", "e", 1)], [(1, [1.0], "a", "e", 1)]):
        assert vector_codes.code_digests(spark.createDataFrame(none, VECTORS)).collect() == []


# --- runs -----------------------------------------------------------------------------------


def runs_by_hand(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                own = w[i : i + length]
                if not any(own[p:] == own[: length - p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r):
    k, n, w = r.choice([1, 2, 2, 3, 5]), r.randint(0, 70), []
    while len(w) < n:
        w += [str(r.randrange(k)) for _ in range(r.randint(1, 5))] * r.choice([1, 1, 4, 9])
    return w[:n]


def test_runs_against_every_place_and_period():
    r = random.Random(2)
    for _ in range(5000):
        w = random_words(r)
        assert periodic_runs.runs_of(w) == runs_by_hand(w), w


def digests_by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *named, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_digests_of_odd_rows(spark, edges, empty):
    got = periodic_runs.run_digests(edges)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = [r for r in edges.collect() if len(r.text or "") < 20_000]
    have = Counter(tuple(r) for r in got.collect())
    assert not Counter(digests_by_hand(r.doc_id, r.text) for r in rows) - have
    assert periodic_runs.run_digests(empty).collect() == []


def test_digests_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = [r for r in docs.collect() if len(r.text or "") < 4_000]
    assert sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in short) > 5
    got = {r.doc_id: tuple(r) for r in periodic_runs.run_digests(docs).collect()}
    assert all(got[r.doc_id] == digests_by_hand(r.doc_id, r.text) for r in short)


def test_long_texts_of_one_word_or_one_period(spark):
    texts = ["a " * 30_000, ("b c d " * 9_000).strip(), " ".join(map(str, range(40_000)))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(got[0].strongest), got[0].collapsed] == [(0, 30_000, 1), "a"]
    assert [tuple(got[1].strongest), got[1].collapsed] == [(0, 27_000, 3), "b c d"]
    assert got[2].runs == [] and got[2].strongest is None
