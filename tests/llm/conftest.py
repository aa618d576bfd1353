import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and to in that is for with on be at by this river stone light garden window paper music bridge winter morning".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        if r.random() < 0.5:
            w += r.choice("abcdefgh") + r.choice("klmnop")
        out.append(w + ("." if i % 12 == 11 else "") + ("\n" if i % 40 == 39 else ""))
    return " ".join(out).replace("\n ", "\n").strip()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, path string"


def edge_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, odd characters; three columns whose names operators use, too."""
    long = prose(5, 20_000)
    texts = [
        None, "", " \n\t ", "word", prose(1, 60), prose(1, 60), prose(2, 300), "a  b\n\nc\td é ́x", "😀 emoji 日本語 ١٢٣ ﬁ",
        "\x00control\x1f and \x85 breaks", long, "x" * 30_000, "1 " * 3000, "same line\n" * 50, "<|endoftext|> a", prose(3, 120) + "\r\nIDIOT!!",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "a", "b", "ä"][i % 4], i, "clash", 0.5, "p") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[6]]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
