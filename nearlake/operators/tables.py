"""Tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table computed once: written to the shared folder of spark.checkpoint.dir, or cached where none is set.

    With ``by``, its last column, rows of each value are in files of their own, so a filter on it reads no others.

    A cached table that is lost with an executor is computed again; a written one isn't lost. It is
    written and not checkpointed because rounds of a loop over checkpoints took ever longer.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
