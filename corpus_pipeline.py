"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again.

1. toxicity: documents that the factorization machine rejects go.
2. near_duplicates: one document of each class of near-duplicates stays.
3. personal_data: spans of personal data are replaced by their kinds.
4. mixing: sources are mixed to target weights; documents may repeat, in training order.
5. packing: token pieces are packed into sequences of 1024.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nearlake.llm.common import materialise, table
from nearlake.llm.mixing import mix_documents
from nearlake.llm.near_duplicates import one_of_each
from nearlake.llm.packing import pack_documents
from nearlake.llm.pii import redact
from nearlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers keep what earlier stages remember, so this one remembers fewer words
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, memo_words=150_000)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained stages nor hash-ordered mixing; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
