"""Periodic runs of words: stretches that repeat with a short period, found for all lags at once by bit planes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import WORD, text_of

#: A run has at least six words and at least four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]


def bit_planes(ids: np.ndarray) -> list[int]:
    """For each bit of the ids an integer whose bit i is that bit of id i."""
    top = int(ids.max()) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(max(1, top.bit_length()))]


def long_stretches(ones: int, n: int) -> int:
    """The bits at which ``n`` ones in a row begin, by ANDs with shifts that double."""
    have = 1
    while ones and have < n:
        step = min(have, n - have)
        ones &= ones >> step
        have += step
    return ones


def matches(planes: list[int], lag: int, n: int, least: int, known: int) -> int:
    """The bits at which ``least`` words in a row equal those ``lag`` places on, none of them in ``known``.

    Planes are added 1, 2, 4, ... at a time; a lag whose mismatches leave no stretch that is long
    enough needs no more of them.
    """
    open_bits = ((1 << (n - lag)) - 1) & ~known
    differ, used, take = 0, 0, 1
    while True:
        for plane in planes[used : used + take]:
            differ |= plane ^ (plane >> lag)
        used += take
        found = long_stretches(open_bits & ~differ, least)
        if not found or used >= len(planes):
            return found
        take = used


def edges(bits: int) -> Iterator[tuple[int, int]]:
    """(first, last) of each stretch of ones."""
    flat = np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    change = np.diff(flat, prepend=0, append=0)
    yield from zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) - 1).tolist())


def runs_of(words: list[str]) -> list[Run]:
    """(start, length, period) of every run of the words, by start, then period.

    A run is a stretch with smallest period q and at least max(6, 4 q) words that no word next to
    it extends. For each lag q the places that equal those q on are ones; a run is a stretch of
    max(6, 4 q) - q ones or more, and the q words after it. A stretch with a smaller period p, which
    then divides q, lies within a run of period p: the places of such runs are left out of lag q.
    They can't be part of a run whose smallest period is q, since a run that shares q words with one of
    period p has that period all over.
    """
    n = len(words)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    planes = bit_planes(ids)
    found: list[Run] = []
    covered: dict[int, list[tuple[int, int]]] = {}  # lag: (first, ones) of runs of periods that divide it
    for lag in range(1, n // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * lag)
        if n < least:
            break
        known = 0
        for first, ones in covered.pop(lag, ()):
            known |= ((1 << ones) - 1) << first
        bits = matches(planes, lag, n, least - lag, known)
        if not bits:
            continue
        for first, last in edges(bits):
            length = last - first + least
            found.append((first, length, lag))
            for multiple in range(2 * lag, length // LEAST_PERIODS + 1, lag):
                covered.setdefault(multiple, []).append((first, length - multiple))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period as exact numbers; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that some run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(change)[:-1].tolist()) if not inside]


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words as the contract changes them: by the checksum of its id a tenth of the documents repeats from some place on."""
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_WORD = re.compile(WORD)

#: Rows that a task turns into words at once.
AT_ONCE = 64


def find_runs(docs: DataFrame, repeat_by_id: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, strongest, collapsed) for each document: its periodic runs and its words without repeats.

    ``collapsed`` has the kept words joined by one space. ``repeat_by_id`` first changes words as
    ``planted`` does. Null and empty texts have no words and no runs, and their collapsed text is empty; a null id
    counts as the empty text where ids are hashed. Repeated rows give repeated rows. Columns other than
    doc_id and text are not read. A text of n words needs n / 4 lags of a few operations on n bits each:
    20,000 words take 0.05 s, 200,000 about 5 s, a million about two minutes.
    """
    schema = f"doc_id long, n_words long, runs {RUNS}, strongest struct<start: long, length: long, period: long>, collapsed string"
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    words = _WORD.findall(text.as_py())
                    if repeat_by_id:
                        words = planted(words, doc_id)
                    runs = runs_of(words)
                    best = strongest(runs)
                    rows.append((len(words), [dict(zip(names, r)) for r in runs], best and dict(zip(names, best)), " ".join(collapsed(words, runs))))
                types = (pa.int64(), _RUN, _RUN.value_type, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "n_words", "runs", "strongest", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def run_digests(docs: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the strongest run and digests of all runs and of the collapsed words."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.col("strongest")
    return find_runs(docs, repeat_by_id=True).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
