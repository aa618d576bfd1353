"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent, a session on one machine gets a temporary folder, one for each
    application; on a cluster such a folder would be another one for each executor, so there it
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="nearlake-")
        found = _own_folders[app]
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder once and read it back: lineage ends here.

    Unlike a cached or locally checkpointed table it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(rows: int, rows_per_task: int) -> int:
    return max(1, -(-rows // rows_per_task))


def partitions(spark: SparkSession, rows: int, rows_per_partition: int = 20_000) -> int:
    """Partitions of a shuffle of so many rows: what the session is set to, or more where these would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks_for(rows, rows_per_partition))


def under_plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns c0, c1, ... whatever they were called, and the map from old names to new ones.

    An operator that keeps its input's columns works on these, so none of its own names clashes.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def row_hash(docs: DataFrame, seed: int | None = None) -> Column:
    """A hash of a whole row, another one for each seed; nulls count, and types without a hash of their own (maps) count as JSON."""
    plain = lambda t: not re.search(r"\b(?:map|variant)\b", t)
    columns = [F.col(f"`{c}`") if plain(t) else F.to_json(F.col(f"`{c}`")) for c, t in docs.dtypes]
    return F.xxhash64(*columns) if seed is None else F.xxhash64(F.lit(seed), *(x for c in columns for x in (c, c.isNull())))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """Adds a key of 128 bits that a row keeps whenever the table is read: two hashes of all its columns. Only equal rows share it."""
    return docs.withColumn(name, F.struct(row_hash(docs).alias("k1"), row_hash(docs, 1).alias("k2")))
