"""Text forms of vectors, labels, truth and results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(value: Column, separator: str, kind: str = "float") -> Column:
    """Numbers of a line; empty fields, as after a closing separator, are left out."""
    fields = F.filter(F.split(F.trim(value), separator), lambda x: x != "")
    return F.transform(fields, lambda x: x.cast(kind))


def vectors_of_lines(lines: DataFrame, separator: str = r"\|", kind: str = "float") -> DataFrame:
    """(meta, v) of lines ``meta TAB x|y|...``; without a TAB the whole line is the vector and meta is null."""
    cut = F.instr("value", "\t")
    meta = F.when(cut > 0, F.substring("value", F.lit(1), cut - 1))
    return lines.select(meta.alias("meta"), numbers(F.substring(F.col("value"), cut + 1, F.length("value")), separator, kind).alias("v"))


def read_vectors(spark: SparkSession, path: str, separator: str = r"\|", kind: str = "float") -> DataFrame:
    return vectors_of_lines(spark.read.text(path), separator, kind)


def read_tsv(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """One vector per line, numbers apart by white space."""
    return spark.read.text(path).select(numbers(F.col("value"), r"\s+", kind).alias("v"))


def parse_labels(lines: DataFrame) -> DataFrame:
    """(id, label) for each label of a comma-separated line; a line without one is an error."""
    fields = F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != "")
    checked = F.when(F.size(fields) > 0, fields).otherwise(F.raise_error(F.concat(F.lit("no label for point "), F.col("id").cast("string"))))
    return lines.select("id", F.explode(checked).alias("label"))


def expand_universal(labels: DataFrame, universal: str) -> DataFrame:
    """A point with the universal label gets every other label of the table in place of its own."""
    marked = labels.where(F.col("label") == universal).select("id").distinct()
    every = labels.where(F.col("label") != universal).select("label").distinct()
    return labels.join(marked, "id", "left_anti").unionByName(marked.crossJoin(every))


def sorted_labels(lines: DataFrame) -> DataFrame:
    return lines.select("id", F.sort_array(F.transform(F.split("line", ","), lambda x: x.cast("int"))).alias("labels"))


def result_lines(found: DataFrame) -> DataFrame:
    """(qid, line): ``qid:`` and then ``distance@id|`` for each result in order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "d", "id")))
    items = F.transform(ordered, lambda r: F.concat(r["d"].cast("string"), F.lit("@"), F.coalesce(r["id"].cast("string"), F.lit("NULL")), F.lit("|")))
    return found.groupBy("qid").agg(F.concat(F.col("qid").cast("string"), F.lit(":"), F.array_join(items, "")).alias("line"))


def truth_rows(wide: DataFrame) -> DataFrame:
    """(qid, rank, id) of rows (qid, ids)."""
    return wide.select("qid", F.posexplode("ids").alias("p", "id")).select("qid", (F.col("p") + 1).alias("rank"), "id")


def checked_tags(rows: DataFrame) -> DataFrame:
    """Rows whose tags fit 32 unsigned bits and aren't 0; another tag is an error when it is read."""
    fair = F.col("tag").between(1, (1 << 32) - 1)
    return rows.withColumn("tag", F.when(fair, F.col("tag")).otherwise(F.raise_error(F.lit("a tag is 0 or beyond 32 bits"))))


def random_vectors(like: DataFrame, seed: int = 1) -> DataFrame:
    """(id, v): for each row (id, v) a vector of normal components, as long in both senses: as many components, the same norm.

    Components follow from hashes of the id, so the table is the same whenever it is computed. A null vector stays null.
    """
    part = lambda i, s: (F.shiftrightunsigned(F.xxhash64(F.col("id"), i, F.lit(s)), 11) + 0.5) / float(1 << 53)
    normal = lambda x, i: F.sqrt(-2 * F.log(part(i, 2 * seed))) * F.cos(2 * math.pi * part(i, 2 * seed + 1))
    length = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    drawn = like.select("id", length(F.col("v")).alias("__n"), F.transform("v", normal).alias("v"))
    return drawn.withColumn("__m", length(F.col("v"))).select("id", F.transform("v", lambda x: x / F.col("__m") * F.col("__n")).alias("v"))


def zipf_labels(points: DataFrame, n_labels: int, seed: int = 2) -> DataFrame:
    """(id, labels): for each point label i with probability 0.7 / i, by hashes of its id; a point without one gets 0."""
    drawn = lambda i: (F.shiftrightunsigned(F.xxhash64(F.col("id"), i, F.lit(seed)), 11) + 0.5) / float(1 << 53) < 0.7 / i
    found = F.filter(F.sequence(F.lit(1), F.lit(n_labels)), drawn)
    return points.select("id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0))).alias("labels"))
