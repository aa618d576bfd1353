"""The inputs that most named queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlake.plans.registry import table


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as (id, v, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


#: Queries are the rows whose id this divides, so their number grows with the table.
EVERY = 20


def stated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query vectors, every twentieth embedding, as (qid, q, qlabel)."""
    return base(spark, sf_dir).where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("qlabel"))


def centroids(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """Fixed centroids (cid, c): every fiftieth embedding."""
    return base(spark, sf_dir).where(F.col("id") % every == 0).select(F.col("id").alias("cid"), F.col("v").alias("c"))
