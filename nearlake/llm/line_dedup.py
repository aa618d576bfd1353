"""Lines that several documents share: all but the first document's are dropped, by bitmaps of the lines to keep.

DataFrame functions alone; no Python runs in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.functions.sampling import in_sample
from nearlake.llm.common import materialise, partitions, text_of

#: White space that is stripped from a line's ends, and the least number of code points of a key.
WHITE, LEAST_KEY = " \t\n\x0b\x0c\r", 10

#: A null id counts as this one, the largest.
LAST_ID = (1 << 63) - 1

#: Frequent keys are looked for in about so many documents, chosen by a hash; a key that holds more than one of
#: ``FREQUENT`` rows there, and at least ``LEAST_ROWS``, is dealt to several tasks. At most ``MOST_FREQUENT`` keys are, the
#: most frequent ones: their table is broadcast. None of this changes a result.
SAMPLE_DOCS, FREQUENT, LEAST_ROWS, MOST_FREQUENT = 16_384, 1_000, 32, 4_096

#: Lines with keys in a task.
LINES_PER_TASK = 500_000


def key_of(line: Column) -> Column:
    """A line in which A-Z are lower-cased already, without white space at its ends."""
    return F.btrim(line, F.lit(WHITE))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else. Texts of one byte a character take the faster way to the same."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, letters, letters.lower()))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, row, text): doc is the id or the number that a null id counts as; row tells texts of one id apart."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return plain.select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("row"), "text")


def keyed_lines(rows: DataFrame) -> DataFrame:
    """(doc, row, pos, h1, h2) of each line whose key has ten code points or more: its place and 128 bits of its key's hash."""
    lines = rows.select("doc", "row", F.posexplode(F.split(lowered(F.col("text")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "row", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= LEAST_KEY)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def frequent_keys(rows: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, parts) of the keys that are too frequent for one task, and the number of tasks.

    A key is dealt to twice as many parts as its share of all lines has tasks.
    """
    spark, n = rows.sparkSession, rows.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    counts = keyed_lines(rows.where(in_sample(share, "doc", seed=11))).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    counts = materialise(counts, "line-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    tasks = partitions(spark, int(total / share), LINES_PER_TASK)
    often = counts.where((F.col("n") >= LEAST_ROWS) & (F.col("n") * FREQUENT > total)).orderBy(F.desc("n"), "h1", "h2").limit(MOST_FREQUENT)
    return often.select("h1", "h2", F.ceil(F.col("n") / F.lit(float(max(1, total))) * (2 * tasks) + 1).cast("int").alias("parts")), tasks


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(doc, row, pos) of every line to drop: its key is in a document of a smaller id too.

    Hashes are dealt to tasks in ranges, which for hashes are of equal width, and sorted within a
    task by document and place, so that the first row of a key has its first document and all others of
    another document go. A frequent key's rows are dealt to several tasks, each of which finds a first
    document of its own; the least of these, a row for each such key, then holds for all.
    """
    often, tasks = frequent_keys(rows)
    lines = keyed_lines(rows).join(F.broadcast(often), ["h1", "h2"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc", "row", "pos"), F.col("parts")).cast("int"), F.lit(0))
    lines = lines.select("doc", "row", "pos", "h1", "h2", part.alias("part"), F.col("parts").isNotNull().alias("often"))
    # the range of a hash: its upper 31 bits, from 0 on, times the number of tasks, over 2 ** 31; parts go to other ranges
    at = F.shiftright(F.shiftrightunsigned("h1", 33) * tasks, 31)
    spread = F.pmod(at + F.when(F.col("often"), F.col("part") * 7919).otherwise(0), F.lit(tasks)).cast("int")
    dealt = lines.withColumn("range", spread).repartitionById(tasks, "range")
    same = W.partitionBy("range", "h1", "h2", "part").orderBy("doc", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = dealt.withColumn("first", F.first("doc").over(same)).where(F.col("often") | (F.col("doc") > F.col("first")))
    found = materialise(found.select("h1", "h2", "often", "doc", "row", "pos", "first"), "repeated-lines")
    least = found.where("often").groupBy("h1", "h2").agg(F.min("first").alias("least"))  # at most MOST_FREQUENT rows
    return found.join(F.broadcast(least), ["h1", "h2"], "left").where(F.col("doc") > F.coalesce("least", "first")).select("doc", "row", "pos")


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc, row, n_dropped, words) for each document that loses lines.

    ``words`` is the bitmap of the lines that stay, compressed: (word, keep) for each 64 lines of which some
    go, in order; bit i of keep is line 64 word + i. Words of ones alone are left out.
    """
    return bitmaps_of(repeated_lines(numbered(docs)))


def bitmaps_of(repeated: DataFrame) -> DataFrame:
    words = repeated.repartition("doc", "row").groupBy("doc", "row", F.shiftright("pos", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("gone"))
    kept = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep"))))
    return words.groupBy("doc", "row").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), kept.alias("words"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of documents, text without the lines that an earlier document has.

    A line is what stands between two line feeds; a null or empty text is one empty line. Its key is the line without
    white space at its ends, A-Z lower-cased. Lines whose key has at least ten code points and is in
    at least two documents go, except in the document of the smallest id; within a document repeats stay or go
    together. A null id counts as the largest number. Rows of one id are one document: they never
    take lines from each other. Other columns are ignored. An empty table gives no rows. Texts of any length are
    split whole; only hashes, ids and places of lines are shuffled to find repeats, and bitmaps return to the texts.
    """
    rows = numbered(docs)
    found = bitmaps_of(repeated_lines(rows))
    # from words to one number for each 64 lines up to the last word, so that a line finds its bit at once
    fill = F.transform("words", lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - F.when(i == 0, 0).otherwise(F.col("words")[i - 1]["word"] + 1)), F.array(w["keep"])))
    found = found.select("doc", "row", "n_dropped", F.flatten(fill).alias("keep"))
    joined = rows.join(found, ["doc", "row"], "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (line, i) -> (shiftright(coalesce(get(keep, shiftright(i, 6)), -1L), i & 63) & 1L) = 1L), '\\n')")
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("text"))


def dedup_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of documents."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
