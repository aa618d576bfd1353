"""Mixing sources to target weights over a time-varying curriculum, in DataFrame functions only.

A source's share of the training stream follows a weight schedule w(t) over training time t in
[0, 1]. Its integral D(t) is the part of the source's target that is due by t. A document whose
words begin at the fraction x of its source's target gets the position t with D(t) = x, and the
documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.llm.common import WORD, materialise, partitions, row_hash, tasks_for, text_of, under_plain_names
from nearlake.operators.partition import with_places

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Slopes of the sources' weight schedules w(t) = 1 + slope * (2 t - 1), repeating in source order.
SLOPES = (-0.5, 0.0, 0.5)
ROWS_PER_BUCKET = 500
#: Bound of the hash buckets, so of the rows per source whose sums meet in one task.
MAX_BUCKETS = 8_192


def _cycle(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, slopes=SLOPES) -> DataFrame:
    """One row per source: its size, weight, target and schedule.

    ``share`` times all sizes is dealt out by weight; a target stops at ``max_epochs`` times its
    source's size and the excess is dealt again among the others, until none is above. Each round
    is one sum over the sources, of which there may be many: the words per unit of weight that
    are left for the sources below their limit. It only rises, so a source once at its limit
    stays there.
    """
    by_source = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = with_places(by_source.withColumn("order", order), "order", "rank").select(
        "source", "source_size", _cycle(F.col("rank"), weights).alias("weight"), _cycle(F.col("rank"), slopes).alias("slope")
    )
    limit = F.col("source_size") * float(max_epochs)
    level, full = 0.0, -1
    while True:
        at_limit = limit <= F.col("weight") * level if full >= 0 else F.lit(False)
        sums = ranked.agg(
            F.coalesce(F.sum("source_size") * share - F.sum(F.when(at_limit, limit).otherwise(0.0)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight"))), F.lit(0.0)),
            F.count_if(at_limit),
        ).first()
        if sums[2] == full or not sums[1]:
            break
        full, level = sums[2], sums[0] / sums[1]
    target = F.least(limit, F.col("weight") * level)
    return ranked.withColumn("target", target)


def invert_demand(x: Column, slope: Column) -> Column:
    """The time t in [0, 1] with D(t) = x, for D(t) = t + slope * (t * t - t)."""
    linear = 1 - slope
    root = F.sqrt(linear * linear + 4 * slope * x)
    return F.when(F.abs(slope) < 1e-9, x).otherwise(2 * x / (linear + root))


def document_sizes(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, source, the number of words (null text: 0) and a hash of the text, which tells rows with equal ids apart."""
    text = text_of()
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"), *kept)


def mix_sizes(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS, slopes=SLOPES, rows_per_bucket=ROWS_PER_BUCKET) -> DataFrame:
    """The mix for a table of ``document_sizes``, which it reads several times; further columns stay.

    Words are taken from a source's documents in hash order, epoch after epoch, up to the whole
    part of its target; the document at the end of it may be taken in part. Prefix sums of a
    source run over hash buckets: sums of buckets first, then rows within one bucket, so the
    rows of a large source are spread over many tasks.
    """
    n_buckets = min(MAX_BUCKETS, tasks_for(sizes.count(), rows_per_bucket))
    key = F.xxhash64("doc_id", "text_hash", F.lit(17))
    dealt = sizes.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(n_buckets)))
    buckets = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    targets = source_targets(sizes, weights, share, max_epochs, slopes)
    per_bucket = starts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    per_bucket = per_bucket.withColumnsRenamed({"source": "of", "bucket": "in"})
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        per_bucket, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))
    )
    start = F.col("bucket_start") + F.col("in_bucket")
    goal = F.floor("target")
    due = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("source_size") * e - F.col("start"))) for e in range(max_epochs)]
    at = [F.when(due[e] > 0, invert_demand((F.col("start") + F.col("source_size") * e) / F.col("target"), F.col("slope"))) for e in range(max_epochs)]
    return placed.withColumn("start", start).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        sum(due[1:], due[0]).cast("long").alias("taken"),
        F.array(*(d.cast("long") for d in due)).alias("taken_by_epoch"),
        F.array(*at).alias("positions"),
        *(c for c in sizes.columns if c not in ("doc_id", "source", "size", "text_hash")),
    )


def mix(docs: DataFrame, n_sorted: int | None = None, **options) -> DataFrame:
    """Mix all documents: one row per document, range-sorted by its first position.

    ``taken`` counts the words that the mix takes of it, repeats included: at most ``max_epochs``
    times its size. ``positions`` holds a position in [0, 1] for each epoch that takes some of it,
    else null. Documents without words take none and come last. A null source is a source of
    its own, after the others. An empty table gives no rows.
    """
    sizes = materialise(document_sizes(docs), "sizes")
    mixed = materialise(mix_sizes(sizes, **options).withColumn("position", F.expr("positions[0]")), "mix")
    parts = n_sorted or partitions(docs.sparkSession, sizes.count(), 500_000)
    # Without a position (nothing taken) documents are spread by a hash, above all positions.
    order = F.coalesce("position", 2 + F.abs(F.xxhash64("doc_id")) / F.lit(2.0**63))
    return mixed.repartitionByRange(parts, order, "doc_id").sortWithinPartitions(order, "doc_id")


def occurrences(mixed: DataFrame, *kept: str) -> DataFrame:
    """One row for each time the mix takes a document: doc_id, epoch, position and words taken."""
    rounds = F.transform("taken_by_epoch", lambda n, e: F.struct(e.alias("epoch"), n.alias("words"), F.col("positions")[e].alias("position")))
    return mixed.select("doc_id", "size", *kept, F.inline(F.filter(rounds, lambda r: r["words"] > 0)))


def mix_documents(docs: DataFrame, n_sorted: int | None = None, **options) -> DataFrame:
    """The mixed documents themselves: a row for each epoch that takes a document, range-sorted by position.

    Documents stay whole, so one that an epoch takes in part is there if at least half of its
    words are. Documents without words, which no target counts, are there once, at the end.
    Columns stay as they are, whatever they are called. Every row counts as a document of its
    own, with or without an id or one that repeats. Rows are known by two hashes of all their columns, so no numbered
    copy of the table is written; rows that are equal in all columns, if there are any, are read as one and
    are there as often as the mix takes them all.
    """
    held, names = under_plain_names(docs)
    keyed = held.withColumns({"k1": row_hash(held), "k2": row_hash(held, 1)})
    renamed = keyed.select("k1", "k2", *(F.col(names[c]).alias(c) for c in ("doc_id", "source", "text")))
    sizes = materialise(document_sizes(renamed, "k1", "k2"), "sizes")
    mixed = materialise(mix_sizes(sizes, **options), "mix")
    taken = occurrences(mixed, "k1", "k2").where(2 * F.col("words") >= F.col("size")).select("k1", "k2", "position")
    places = taken.unionAll(sizes.where("size = 0").select("k1", "k2", F.lit(2.0).alias("position")))
    n = sizes.count()
    if sizes.select("k1", "k2").distinct().count() < n:
        keyed = keyed.dropDuplicates(["k1", "k2"])  # one a task before they are shuffled
    parts = n_sorted or partitions(docs.sparkSession, n)
    found = keyed.join(places, ["k1", "k2"]).repartitionByRange(parts, "position", names["doc_id"]).sortWithinPartitions("position", names["doc_id"])
    return found.select(*(F.col(plain).alias(c) for c, plain in names.items()))
