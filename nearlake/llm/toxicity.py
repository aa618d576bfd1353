"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their beginnings of three to six letters, so inflected forms of a
known word are recognised; each is present or absent. Beside a weight, every term has a vector,
and the score of a text adds the inner products of its terms' vectors: pairs such as an insult
with the mention of a group can weigh more than the sum of both.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearlake.functions.sampling import in_sample
from nearlake.llm.common import text_of, under_plain_names

BUCKETS = 1 << 20
#: Bound of the sample of labelled rows that the machine is fitted on.
MAX_ROWS = 8_000
RANK = 8
#: A text is rejected from this score on.
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+").findall


def _terms_of_word(word: str) -> list[int]:
    names = ["=" + word, *("^" + word[:k] for k in range(3, min(len(word), 7)))]
    return [xxhash.xxh32_intdigest(n) % BUCKETS for n in names]


def terms(text: str) -> set[int]:
    """Hashed terms of a whole text."""
    out: set[int] = set()
    for word in set(_WORDS(text.lower())):
        out.update(_terms_of_word(word))
    return out


@dataclass(frozen=True)
class Machine:
    """Weights by hashed term; terms without one don't count."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def scorer(self):
        """score(text) in [0, 1]; a memo keeps which words have terms that count."""
        place = {b: i for i, b in enumerate(self.buckets.tolist())}
        memo: dict[str, tuple[int, ...]] = {}
        bias, weights, vectors = self.bias, self.weights, self.vectors
        squares = (vectors**2).sum(axis=1)

        def score(text: str) -> float:
            active: set[int] = set()
            for word in set(_WORDS(text.lower())):
                found = memo.get(word)
                if found is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    found = memo[word] = tuple(place[t] for t in _terms_of_word(word) if t in place)
                if found:
                    active.update(found)
            z = bias
            if active:
                at = np.fromiter(active, np.int64, len(active))
                at.sort()  # the same sum for equal texts, whatever the order in the set
                together = vectors[at].sum(axis=0)
                z += float(weights[at].sum()) + 0.5 * float(together @ together - squares[at].sum())
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def select_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The terms whose chi-square against the labels is beyond chance: all of them, at most BUCKETS."""
    n, positive = len(rows), int(labels.sum())
    total, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, labels):  # a row's terms are distinct
        total[row] += 1
        if label:
            hits[row] += 1
    expected = total * positive / n
    variance = expected * (1 - positive / n) * (n - total) / max(n - 1, 1)
    chi = (hits - expected) ** 2 / np.maximum(variance, 1e-9)
    return np.flatnonzero((chi > 10.8) & (total >= min(3, max(1, positive // 4))) & (total < n))


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = RANK, epochs: int = 60, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Fit a factorization machine with the logistic loss by AdaGrad over mini-batches."""
    n, positive = len(rows), float(labels.sum()) if len(rows) else 0.0
    base = math.log((positive + 0.5) / (n - positive + 0.5)) if n else math.log(0.05)
    none = Machine(base, np.empty(0, np.int64), np.empty(0), np.empty((0, rank)))
    if not n or positive in (0, n):
        return none
    chosen = select_terms(rows, labels)
    if not len(chosen):
        return none
    place = [np.flatnonzero(np.isin(chosen, r, assume_unique=True)) for r in rows]
    random = np.random.Generator(np.random.PCG64(7))
    k = len(chosen)
    bias, weights, vectors = base, np.zeros(k), random.normal(0, 0.01, (k, rank))
    g_bias, g_weights, g_vectors = 1.0, np.ones(k), np.ones((k, rank))
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            lengths = np.array([len(place[i]) for i in batch])
            row = np.repeat(np.arange(len(batch)), lengths)
            col = np.concatenate([place[i] for i in batch])
            sums = np.zeros((len(batch), rank))
            np.add.at(sums, row, vectors[col])
            squares = np.bincount(row, (vectors[col] ** 2).sum(axis=1), len(batch))
            z = bias + np.bincount(row, weights[col], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]
            step = wrong.sum() / len(batch)
            g_bias += step**2
            bias -= rate * step / math.sqrt(g_bias)
            touched, where = np.unique(col, return_inverse=True)
            slope = np.bincount(where, wrong[row], len(touched)) / len(batch) + decay * weights[touched]
            g_weights[touched] += slope**2
            weights[touched] -= 10 * rate * slope / np.sqrt(g_weights[touched])
            v_slope = np.zeros((len(touched), rank))
            np.add.at(v_slope, where, wrong[row, None] * (sums[row] - vectors[col]))
            v_slope = v_slope / len(batch) + decay * vectors[touched]
            g_vectors[touched] += v_slope**2
            vectors[touched] -= rate * v_slope / np.sqrt(g_vectors[touched])
    return Machine(float(bias), chosen.astype(np.int64), weights, vectors)


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Machine:
    """Fit on a sample of at most about ``max_rows`` labelled rows that are not held out.

    A label without a document, or a null label, doesn't count; of repeated labels the largest
    holds. The sample takes the rows whose hash is below a fraction of its range, however small
    that fraction is. Of documents of one id the least text counts, so there is one row for each sampled label
    however often an id repeats. Only hashed terms of these rows come to the driver.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("double").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(in_sample(share, "of"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "terms"])

    # The sample is bounded by max_rows, so it may be broadcast.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("of"))
    rows = rows.groupBy("of").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    got = rows.select("y", "text").mapInArrow(hashed, "y double, terms array<int>").toArrow()
    parts = got.column("terms").combine_chunks()
    if isinstance(parts, pa.ChunkedArray):
        parts = pa.concat_arrays(parts.chunks) if parts.num_chunks else pa.array([], pa.list_(pa.int32()))
    ends, values = parts.offsets.to_numpy(), parts.values.to_numpy()
    each = [values[a:b] for a, b in zip(ends, ends[1:])]
    y = got.column("y").to_numpy()
    order = sorted(range(len(each)), key=lambda i: (y[i], len(each[i]), each[i].tobytes()))  # whatever order they came in
    return fit([each[i] for i in order], y[order], **options)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Adds score, a double in [0, 1], to each row from its text alone; null and empty texts get the base rate's."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # at most BUCKETS * (RANK + 2) numbers, as many as the sample has telling terms
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.scorer()
        for batch in batches:
            scores = [of(t.as_py()) for t in batch.column("__text")]
            rest = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64())], [*names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.withColumn("__text", text_of()).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted. Repeated rows get equal scores; an empty table gives no rows."""
    machine = train(docs, labels)
    ids = score(docs.select("doc_id", "text"), machine)
    return ids.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; columns stay as they are."""
    machine = train(docs, labels)
    held, names = under_plain_names(docs)  # whatever the columns are called
    kept = score(held.withColumn("text", F.col(names["text"])), machine).where(F.col("score") < threshold)
    return kept.select(*(F.col(plain).alias(c) for c, plain in names.items()))
