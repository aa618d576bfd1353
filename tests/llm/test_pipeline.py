import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
from nearlake.llm import pii, toxicity
from nearlake.llm.common import WORD, shared_dir

from .conftest import edge_rows, prose
from .test_mixing import targets_by_rounds
from .test_near_duplicates import brute as all_pairs
from .test_near_duplicates import family
from .test_packing_and_files import check_packing


def test_stages_keep_columns_and_chain(spark, tmp_path, edges):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(15, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == edges.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() > 0
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r[0] for r in edge_rows()}


def test_run_on_real_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def planted_corpus():
    """Documents of several sources: prose, near copies, equal texts, personal data, insults, nulls."""
    r = random.Random(6)
    texts = [prose(200 + i, 60 + i % 50) for i in range(60)]
    texts += family(r, prose(1, 150), 8, 1) + family(r, prose(2, 150), 5, 3) + [prose(3, 90)] * 4
    texts += [f"{prose(300 + i, 30)} write to name{i}@mail.org or +1 (858) 555-{2000 + i} from 10.0.{i}.7 {prose(400 + i, 20)}" for i in range(12)]
    texts += [f"{prose(500 + i, 40)} vermin foreigners {prose(600 + i, 10)}" for i in range(20)] + [None, "", "one two"]
    r.shuffle(texts)
    return [(i, t, "en", ["a", "b", None, "hot", "hot"][i % 5], i) for i, t in enumerate(texts)]


def test_stages_against_plain_versions(spark, tmp_path):
    """Each stage's rows are those that a plain version makes of its input."""
    rows = planted_corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marked = [(i, 1, int("vermin" in (t or ""))) for i, t, *_ in rows]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def after(name):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    # toxicity: the machine's score, pair by pair
    machine = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    place = {int(b): i for i, b in enumerate(machine.buckets)}

    def score(text):
        at = [place[t] for t in toxicity.terms(text or "") if t in place]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.vectors[i] @ machine.vectors[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    want = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    docs = after("toxicity")
    assert sorted(map(tuple, docs.collect())) == sorted(want)
    assert 0 < len(rows) - len(want) and sum("vermin" in (r[1] or "") for r in want) <= 2

    # near duplicates: the least id of each class by all pairs
    classes = {i: c for i, c, _ in all_pairs([r[:2] for r in want])}
    want = [r for r in want if classes[r[0]] == r[0]]
    docs = after("near_duplicates")
    assert sorted(map(tuple, docs.collect())) == sorted(want)

    # personal data: the spans cut out of the text one by one
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    cleaned = []
    for r in want:
        found = sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans[r[0]].split(",") if x))
        out, at = "", 0
        for a, b, kind in found:
            if a >= at:
                out += r[1][at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        cleaned.append((r[0], r[1] if not found else out + r[1][at:], *r[2:]))
    docs = after("personal_data")
    assert sorted(map(tuple, docs.collect())) == sorted(cleaned)
    assert sum("<EMAIL>" in (r[1] or "") for r in cleaned) == 12

    # mixing: each source near its target, documents whole, unchanged and at most twice
    before = {r[0]: r for r in cleaned}
    docs = after("mixing")
    mixed = [tuple(r) for r in docs.collect()]
    size = {i: len(re.findall(WORD, r[1] or "")) for i, r in before.items()}
    by_source, taken = Counter(), Counter()
    for r in cleaned:
        by_source[r[3]] += size[r[0]]
    assert all(r == before[r[0]] for r in mixed) and max(Counter(r[0] for r in mixed).values()) <= 2
    assert {r[0] for r in cleaned if not size[r[0]]} <= {r[0] for r in mixed}
    for r in mixed:
        taken[r[3]] += size[r[0]]
    for source, target in targets_by_rounds(by_source).items():
        assert abs(taken[source] - target) <= max(size.values())

    # packing: every piece of every document in its place
    texts = defaultdict(list)
    for r in mixed:
        texts[r[0]].append(r[1] or "")
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    n = check_packing(packed, texts, 1024)
    assert n <= -(-sum(r.length for r in packed) // 1024) + 2


def test_stages_leave_no_copy_of_the_texts(spark, tmp_path):
    """What a stage stores for itself is small beside its input: hashes and places, no texts."""
    shared = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda folders: sum(p.stat().st_size for f in folders for p in f.rglob("*.parquet"))
    words = lambda r: " ".join(f"{r.getrandbits(60):x}" for _ in range(600))
    rows = [(i, words(random.Random(i // 2)) + " name@mail.org", "en", "abc"[i % 3], i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, read = spark.read.parquet(str(tmp_path / "documents.parquet")), size([tmp_path / "documents.parquet"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = set(shared.iterdir())
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        assert size(set(shared.iterdir()) - before) < 0.25 * read, name
        docs, read = spark.read.parquet(str(tmp_path / name)), size([tmp_path / name])
    assert docs.count() > 0
