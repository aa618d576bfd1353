"""Quality rules by weak supervision.

Each rule looks at one trait of a text and votes good, bad or abstains. How often each
combination of votes occurs over all documents is counted in Spark; expectation-maximisation on
these counts estimates each rule's accuracy for good and for bad texts. A text's posterior
probability of being good takes the place of a filter that all rules must pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import WORD, materialise, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5

# Symbols counted by the contract; frequent function words of four languages.
SYMBOLS = re.compile(r"[#*$%&|<>]")
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for as with on be are this was at by an or "
    "de la le les et des en un une du que est pour dans qui par "
    "der die das und zu den von mit dem nicht ein eine auf ist "
    "el los las y del se por con una su para como no".split()
)
ENDINGS = ".!?:;\"')]»”"

#: Rules: (name, bad test, good test) on the trait columns below; neither abstains.
RULES = (
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    ("repeated_words", "n_repeat_words > 0.2 * n_words", "n_repeat_words < 0.05 * n_words"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2.5 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("capitals", "n_capital_words > 0.4 * n_words", "n_capital_words < 0.1 * n_words"),
    ("letters", "n_letter_words < 0.75 * n_words", "n_letter_words > 0.9 * n_words"),
    ("function_words", "n_function_words < 0.02 * n_words", "n_function_words > 0.08 * n_words"),
    ("commonest_word", "n_commonest > 0.25 * n_words AND n_words >= 20", "n_commonest < 0.15 * n_words"),
    ("endings", "n_ended_lines < 0.3 * n_lines", "n_ended_lines > 0.6 * n_lines"),
)

TRAITS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capital_words n_letter_words n_function_words n_commonest n_ended_lines"
).split()

_find_words = re.compile(WORD).findall
_has_word = re.compile(WORD).search


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    n = len(codes) - 2
    if n < 2:
        return 0
    size = int(codes.max()) + 1
    pair = codes[:-1] * size + codes[1:]
    if size >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, where, times = np.unique(pair[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    often = times[where] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + n] |= often
    return int(covered.sum())


def traits(text: str) -> tuple[int, ...]:
    """The counts named in TRAITS, over the whole text."""
    words = _find_words(text)
    if not words:
        return (0,) * len(TRAITS)
    lines = [line for line in text.split("\n") if _has_word(line)]
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    times = np.bincount(codes).tolist()
    capitals = letters = function = 0
    for word, n in zip(number, times):
        bare = word.strip(".,;:!?\"'()")
        if bare.isalpha():
            letters += n
            if len(bare) > 1 and bare.isupper():
                capitals += n
            if bare.lower() in FUNCTION_WORDS:
                function += n
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated_words(codes),
        len(lines),
        capitals,
        letters,
        function,
        max(times),
        sum(line.rstrip()[-1:] in ENDINGS for line in lines),
    )


def with_traits(docs: DataFrame) -> DataFrame:
    """doc_id and the trait columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [traits(t.as_py()) for t in batch.column(1)]
            columns = zip(*found) if found else [[]] * len(TRAITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *TRAITS])

    schema = "doc_id long, " + ", ".join(f"{t} long" for t in TRAITS)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(count, schema)


def votes() -> list[Column]:
    """A column per rule: 1 for good, -1 for bad, 0 for an abstention."""
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(name) for name, bad, good in RULES]


@dataclass(frozen=True)
class Model:
    prior: float
    #: For each rule the probabilities of votes -1, 0, 1 on good and on bad texts.
    good: tuple[tuple[float, ...], ...]
    bad: tuple[tuple[float, ...], ...]

    def log_odds(self) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for (name, *_), g, b in zip(RULES, self.good, self.bad):
            weights = [math.log(x / y) for x, y in zip(g, b)]
            out = out + F.element_at(F.array(*(F.lit(w) for w in weights)), F.col(name) + 2)
        return out


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, strength: float = 10.0) -> Model:
    """Expectation-maximisation over (votes, count) pairs.

    Pseudo-counts, which also start the search, say that rules are right more often than not.
    """
    first = {True: (0.05, 0.15, 0.8), False: (0.5, 0.2, 0.3)}
    given = {y: [list(p) for _ in RULES] for y, p in first.items()}
    prior = 0.85
    for _ in range(rounds):
        counts = {y: [[strength * p for p in first[y]] for _ in RULES] for y in first}
        good, total = 0.85 * strength, strength
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(given[True][j][v + 1] / given[False][j][v + 1]) for j, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            good, total = good + n * p, total + n
            for j, v in enumerate(pattern):
                counts[True][j][v + 1] += n * p
                counts[False][j][v + 1] += n * (1 - p)
        prior = min(max(good / total, 0.01), 0.99)
        given = {y: [[c / sum(row) for c in row] for row in counts[y]] for y in counts}
    return Model(prior, tuple(map(tuple, given[True])), tuple(map(tuple, given[False])))


def rate_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the contract's counts, base_failed, the posterior and kept.

    The table of vote patterns has at most 3**9 rows, however many documents there are. Texts
    that fail the base test take no part in the estimation. Null and empty texts count nothing
    and fail the base test. Repeated rows give repeated results; an empty table gives no rows.
    """
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialise(with_traits(docs).withColumn("base_failed", base_failed), "traits").select("*", *votes())
    names = [name for name, *_ in RULES]
    patterns = counted.where("not base_failed").groupBy(*names).count().collect()
    model = fit(sorted((tuple(r[:-1]), r[-1]) for r in patterns))
    return counted.withColumn("posterior", 1 / (1 + F.exp(-model.log_odds()))).select(
        "doc_id",
        *TRAITS[:5],
        "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"),
        "posterior",
    )
