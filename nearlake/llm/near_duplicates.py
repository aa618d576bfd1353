"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Each text becomes its set of five-word shingles; texts with equal sets form a class, and the
   join works on one row per class.
2. A class has ``bands`` x ``rows`` minima of its shingles' hashes. Bands and rows are chosen so
   that a pair at the threshold shares a band with the target recall. Classes are shuffled on
   their band hashes; a bucket with more than ``block`` classes is cut into blocks, and each pair
   of blocks becomes a group of its own.
3. Within a group, pairs whose minima agree well below the threshold are ruled out, and a
   spanning forest of the rest goes on. The connected components of these edges are small
   neighbourhoods that hold every pair worth verifying.
4. The shingle sets are computed again for one document of each class in such neighbourhoods,
   shuffled on the neighbourhood (in pairs of blocks where it is large), and all pairs in it are
   compared exactly. Links are counted there, so a group of n near copies costs its comparisons
   but never emits n * n rows.
5. Components over forests of verified links are the classes of near-duplicates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import WORD, materialise, partitions, text_of, under_plain_names, with_row_key
from nearlake.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Classes in one group of a shuffle: larger buckets and neighbourhoods are cut into blocks. A row is copied once for each
#: block of its group, so blocks are as large as a task bears: minima are short, sets count by their bytes, too.
BLOCK, SET_BLOCK, SET_BYTES = 2048, 1024, 4 << 20
#: Standard deviations by which an estimate from the minima may fall below the threshold.
SLACK = 4.5

#: Bits for each document that the filter lets through to the second shuffle, and its largest size, 16 MB. Beyond that
#: a join picks the documents, so neither a broadcast nor the shuffle grows with what isn't needed.
BITS_PER_PLACE, MAX_FILTER_BITS = 32, 1 << 27

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(WORD).findall


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest chance meetings, that reach the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within max_hashes reaches the recall")
    return best


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one n-gram, an empty one none."""
    found = _words(text)
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(words, len(codes))
    n = len(codes) - span + 1
    with np.errstate(over="ignore"):
        h = np.full(n, span, np.uint64)
        for k in range(span):
            h = (h ^ codes[k : k + n]) * _GOLDEN
            h ^= h >> np.uint64(29)
    return np.unique(h)


@lru_cache
def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray, n_hashes: int) -> np.ndarray:
    """The least value of each of ``n_hashes`` hash functions over the shingles."""
    factors = _factors(n_hashes)
    out = np.full(n_hashes, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 256):
            np.minimum(out, ((h[at : at + 256, None] * factors) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = 0, rows: int = 0) -> DataFrame:
    """row, doc_id, a 128-bit key of the shingle set (null without shingles), its size, band hashes and one byte per minimum.

    ``docs`` has columns row, of any type with an order, doc_id and text.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, band_hashes, marks = [], [], [], []
            for text in batch.column(2):
                h = shingles(text.as_py(), words)
                sizes.append(len(h))
                if not len(h):
                    keys.append(None), band_hashes.append(None), marks.append(None)
                    continue
                least = minima(h, bands * rows)
                data = least.tobytes()
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                band_hashes.append([xxhash.xxh3_64_intdigest(data[4 * rows * b : 4 * rows * (b + 1)], b) - (1 << 63) for b in range(bands)])
                marks.append((least & 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(band_hashes, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["row", "doc_id", "key", "n_shingles", "bands", "marks"],
            )

    schema = f"row {docs.schema['row'].dataType.simpleString()}, doc_id long, key binary, n_shingles long, bands array<long>, marks binary"
    return docs.select("row", F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(sign, schema)


def in_block_pairs(rows: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Copies of the rows such that any two of a group meet exactly once: columns lo and hi name a pair of blocks.

    ``blocks`` is the number of blocks of the row's group.
    """
    n = blocks.cast("int")
    mine = F.pmod(F.xxhash64(member, F.lit(3)), n).cast("int")
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(mine, o).alias("lo"), F.greatest(mine, o).alias("hi")))
    return rows.withColumn("mine", mine).withColumn("pair", F.explode(others)).select("*", "pair.lo", "pair.hi").drop("pair")


def _join(label: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Links from i to one of ``others`` for each label other than its own; these labels become one."""
    kept = []
    for j in others[np.unique(label[others], return_index=True)[1]].tolist():
        if label[j] != label[i]:
            label[label == label[j]] = label[i]
            kept.append(j)
    return kept


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[dict[str, list]]:
    """Groups of consecutive rows with equal values in the first ``n_keys`` columns, as column lists.

    The rows of one group are together in a sorted partition; groups are of bounded size.
    """
    names, held, key = None, None, None
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        start, n = 0, batch.num_rows
        for i, now in enumerate(zip(*columns[:n_keys])):
            if now != key:
                if held is not None and (i > start or held[0]):
                    yield dict(zip(names, [h + c[start:i] for h, c in zip(held, columns)]))
                held, key, start = [[] for _ in names], now, i
        if n:
            held = [h + c[start:n] for h, c in zip(held, columns)]
    if held is not None and held[0]:
        yield dict(zip(names, held))


def _cross(group: dict[str, list]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a group, and whether they are one."""
    mine = np.array(group["mine"])
    lo, hi = group["lo"][0], group["hi"][0]
    return np.flatnonzero(mine == lo), np.flatnonzero(mine == hi), lo == hi


def candidate_edges(classes: DataFrame, n_hashes: int, threshold: float, block: int) -> DataFrame:
    """Edges (a, b) between classes that share a band and whose minima agree nearly as often as the threshold asks."""
    spark = classes.sparkSession
    least_agree = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / n_hashes)
    banded = classes.select("key", "n_shingles", F.explode("bands").alias("hash"))  # a hash tells its band, too
    sizes = banded.groupBy("hash").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    met = materialise(banded.join(sizes, "hash"), "buckets")  # narrow: no minima yet
    marks = classes.join(met.select("key").distinct(), "key", "left_semi").select("key", "marks")
    blocks = in_block_pairs(met.join(marks, "key"), F.ceil(F.col("in_bucket") / block), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            rows, cols, same = _cross(group)
            marks = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(len(group["key"]), -1)
            size = np.array(group["n_shingles"], float)
            label = np.arange(len(size))
            a, b = [], []
            for at, i in enumerate(rows.tolist()):
                others = cols[at + 1 :] if same else cols
                others = others[label[others] != label[i]]
                small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
                others = others[small >= threshold * large]
                if len(others):
                    near = others[(marks[others] == marks[i]).mean(axis=1) >= least_agree]
                    kept = _join(label, i, near)
                    a += [i] * len(kept)
                    b += kept
            if a:
                keys = group["key"]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in a], pa.binary()), pa.array([keys[i] for i in b], pa.binary())], ["a", "b"])

    keys = ["hash", "lo", "hi"]
    parts = partitions(spark, met.count(), 100_000)
    dealt = blocks.select(*keys, "mine", "key", "n_shingles", "marks").repartition(parts, *keys).sortWithinPartitions(*keys, "key")
    return dealt.mapInArrow(compare, "a binary, b binary")


def count_shared(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in ``rows`` with those in ``cols``, by blocks of shingles."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[code]
    which, at = which[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    which, at = which[order], at[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    for first in range(0, len(shared), width):
        lo, hi = np.searchsorted(at, [first, first + width])
        present = np.zeros((len(sets), min(width, len(shared) - first)), np.float32)
        present[which[lo:hi], at[lo:hi] - first] = 1
        out += present[rows] @ present[cols].T
    return out


def _filter_of(places: DataFrame, bits: int) -> np.ndarray:
    """Bits at the given places."""
    bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    words = places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def verified_links(docs: DataFrame, near: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """Exact comparison in neighbourhoods ``near`` (key, row, n_copies, n_shingles, component).

    ``row`` is that of one document with the shingle set. Rows (a, b, links): ``links`` documents
    of other classes are linked with class a as counted in one group; b is a class linked with a,
    or null where the row only counts.
    """
    spark = docs.sparkSession
    n_blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(8 * F.sum("n_shingles") / SET_BYTES))
    sizes = near.groupBy("component").agg(F.count("*").alias("in_component"), n_blocks.alias("blocks"))
    n_near, n_dealt = sizes.agg(F.coalesce(F.sum("in_component"), F.lit(0)), F.coalesce(F.sum(F.col("in_component") * F.col("blocks")), F.lit(0))).first()
    members = near.join(sizes, "component")
    bits = 1 << max(16, (BITS_PER_PLACE * n_near - 1).bit_length() if n_near else 16)
    texts = docs.select("row", text_of().alias("text"))
    held = None
    if bits <= MAX_FILTER_BITS:
        place = F.pmod(F.xxhash64("row"), F.lit(bits))
        held = spark.sparkContext.broadcast(_filter_of(near.select(place.alias("place")), bits))
        texts = texts.select("*", place.alias("place"))
    else:
        texts = texts.hint("merge").join(near.select("row"), "row", "left_semi").select("*", F.lit(0).cast("long").alias("place"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                at = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1))
            sets = [shingles(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "shingles"])

    found = texts.mapInArrow(to_sets, f"row {docs.schema['row'].dataType.simpleString()}, shingles binary")
    sets = found.hint("merge").join(members, "row")
    blocks = in_block_pairs(sets, F.col("blocks"), "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            keys = group["key"]
            rows, cols, same = _cross(group)
            if not len(rows) or not len(cols):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            size = np.array([len(s) for s in sets], float)
            shared = count_shared(sets, rows, cols)
            linked = shared >= threshold * (size[rows][:, None] + size[cols][None, :] - shared) - 1e-6
            if same:
                np.fill_diagonal(linked, False)
            copies = np.array(group["n_copies"], np.int64)
            count = np.zeros(len(keys), np.int64)
            count[rows] += linked @ copies[cols]
            if not same:
                count[cols] += linked.T @ copies[rows]
            label = np.arange(len(keys))
            joined = [(i, j) for at, i in enumerate(rows.tolist()) for j in _join(label, i, cols[linked[at]])]
            some = np.flatnonzero(count)
            a, b = [keys[i] for i, _ in joined], [keys[j] for _, j in joined]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a + [keys[i] for i in some.tolist()], pa.binary()), pa.array(b + [None] * len(some), pa.binary()), pa.array([0] * len(a) + count[some].tolist(), pa.int64())],
                ["a", "b", "links"],
            )

    keys = ["component", "lo", "hi"]
    parts = partitions(spark, n_dealt, 5_000)
    dealt = blocks.select(*keys, "mine", "key", "n_copies", "shingles").repartition(parts, *keys).sortWithinPartitions(*keys, "key")
    return dealt.mapInArrow(verify, "a binary, b binary, links long")


def _classified(docs: DataFrame, words: int, threshold: float, recall: float, block: int) -> DataFrame:
    """For a table (row, doc_id, text), read twice, whose rows have a number or key of their own: row, doc_id, key, n_shingles, and of its shingle set
    ``node`` (the class of near-duplicates), ``copy_id``, ``n_copies`` and ``links``, all null without shingles."""
    bands, rows = plan_bands(threshold, recall)
    signed = materialise(signatures(docs, words, bands, rows), "signatures")
    one = signed.where("key is not null").groupBy("key").agg(
        F.count("*").alias("n_copies"),
        F.min("doc_id").alias("copy_id"),
        F.min("row").alias("row"),
        *(F.first(c).alias(c) for c in ("n_shingles", "bands", "marks")),  # equal for equal sets
    )
    classes = materialise(one, "classes")
    near = connected_components(candidate_edges(classes, bands * rows, threshold, block)).withColumnRenamed("node", "key")
    near = materialise(near.join(classes.select("key", "row", "n_copies", "n_shingles"), "key"), "near")
    links = materialise(verified_links(docs, near, words, threshold, min(block, SET_BLOCK)), "links")
    groups = connected_components(links.where("b is not null").select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    named = (
        classes.select("key", "copy_id", "n_copies")
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
        .join(counts.withColumnRenamed("a", "key"), "key", "left")
        .select("key", F.coalesce("component", "key").alias("node"), "copy_id", "n_copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
    return signed.select("row", "doc_id", "key", "n_shingles").join(named, "key", "left")


def _numbered(docs: DataFrame) -> DataFrame:
    """The table stored with a number for each row."""
    return materialise(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: its class of near-duplicates and its links.

    ``class_id`` is the least document id among all that are connected by links, a link being a
    Jaccard similarity of the shingle sets of at least ``threshold``; ``copy_id`` is the least id
    with an equal shingle set, ``n_copies`` the number of documents with that set, itself
    included, and ``n_links`` the number of other documents linked. Null and empty texts have no
    shingles and no links: each is a class of its own, with n_copies 1. Repeated rows are copies
    of each other, and rows with equal ids and other texts are documents of their own. A row
    without an id counts as any other, but gives no class its name. An empty table gives no rows.
    """
    found = _classified(_numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), words, threshold, recall, block)
    found = materialise(found, "classified")
    least = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    one = F.lit(1).cast("long")
    return found.join(least, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", one).alias("n_copies"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.coalesce("n_copies", one) - 1).alias("n_links"),
        "n_shingles",
    )


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``docs`` with one document of each class of near-duplicates: the one with the least id stays.

    Of equal ids within a class the row with the least hash stays. Rows without an id stay only
    where their class has no row with one. Of texts without shingles (null, empty), which are in
    no class, one row of each id stays, and all without an id. Columns of any type stay as they
    are, whatever they are called. Rows are known by two hashes of all their columns, so no
    numbered copy of the table is written, unless rows are equal in all columns: these are
    stored once.
    """
    held, names = under_plain_names(docs)
    keyed = with_row_key(held, "row")
    doc_id = F.col(names["doc_id"]).cast("long")
    lone = None
    if (keyed.groupBy("row").count().agg(F.max("count")).first()[0] or 0) > 1:
        nameless = doc_id.isNull() & ~text_of(names["text"]).rlike(WORD)  # these all stay, equal or not
        lone = held.where(nameless)
        keyed = materialise(keyed.where(~nameless).dropDuplicates(["row"]), "distinct")
    plain = keyed.select("row", doc_id.alias("doc_id"), F.col(names["text"]).alias("text"))
    found = _classified(plain, words, threshold, recall, block).select("row", "doc_id", "node")
    alone = F.when(F.col("doc_id").isNull(), F.col("row").cast("string")).otherwise(F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    group = F.when(F.col("node").isNull(), alone.cast("binary")).otherwise(F.col("node"))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    kept = found.groupBy(F.col("node").isNull().alias("wordless"), group.alias("group")).agg(F.min(first)["row"].alias("row"))
    out = keyed.hint("merge").join(kept.select("row"), "row", "left_semi").select(*held.columns)
    return (out if lone is None else out.unionAll(lone)).toDF(*docs.columns)
