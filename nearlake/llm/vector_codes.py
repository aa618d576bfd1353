"""Compression of vectors to product codes: integer k-means by Exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import materialise

#: 256 steps a unit, 16 parts, codebooks of 64 entries, two rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2

#: Integer components are held within this bound, so that distances and sums of a part fit 64 bits: |x| up to 131,072.
LARGEST = 1 << 25

#: Label sums of at most this many labels are broadcast; more are joined, with every label's rows dealt to so many parts.
FEW_LABELS, LABEL_PARTS = 65_536, 32


def squares(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to the entries numbered ``at``."""
    step = x - entries.take(at, axis=0)
    return np.einsum("ij,ij->i", step, step)


class Codebooks:
    """The entries of all parts, ``entries[part, entry, component]``, and for each entry all of its part in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        steps = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        between = (steps * steps).sum(axis=-1)
        self.order = np.argsort(between, axis=2, kind="stable")
        self.gaps = np.take_along_axis(between, self.order, axis=2)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of rows x[row, part, component], ties to the lower index, from entries ``start``.

        An entry that is as near to x as the start s, which is at distance r, is within 2 r of s. So the entries in
        order of their distance to s are looked at up to those beyond that radius: in squares, 4 r * r, which
        is an integer as all distances are, so nothing is rounded.
        """
        n_parts, n = self.order.shape[:2]
        flat, order, gaps = self.entries.reshape(n_parts * n, -1), self.order.reshape(-1), self.gaps.reshape(-1)
        x = x.reshape(-1, x.shape[-1])
        first = np.tile(np.arange(n_parts) * n, len(start))  # of each row's and part's entries
        at = order.take((first + start.reshape(-1)) * n)  # of entries equal to the start the first
        d, best = squares(x, flat, first + at), at.copy()
        left = np.flatnonzero(d)  # at distance 0 nothing is nearer
        x, first, reach, least, code = x.take(left, axis=0), first.take(left), 4 * d.take(left), d.take(left), at.take(left)
        lists = (first + code) * n
        for place in range(1, n):
            inside = np.flatnonzero(gaps.take(lists + place) <= reach)
            if len(inside) < len(left):  # the others have seen all that may be nearer
                d[left], best[left] = least, code
                left, x, first, reach, least, code, lists = (y.take(inside, axis=0) for y in (left, x, first, reach, least, code, lists))
                if not len(left):
                    break
            entry = order.take(lists + place)
            found = squares(x, flat, first + entry)
            won = np.flatnonzero((found < least) | ((found == least) & (entry < code)))
            least[won], code[won] = found.take(won), entry.take(won)
        d[left], best[left] = least, code
        return best.reshape(start.shape), d.reshape(start.shape)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_numbers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integer components) of the vectors of this length whose components are all finite numbers."""
    lengths, values = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    starts = np.cumsum(np.nan_to_num(lengths)).astype(np.int64) - np.nan_to_num(lengths).astype(np.int64)
    rows = np.flatnonzero(lengths == width)
    x = flat[starts[rows][:, None] + np.arange(width)[None, :]]
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(x[good] * SCALE), -LARGEST, LARGEST).astype(np.int64)


def codes_of(x: np.ndarray, books: list[Codebooks]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) under the last of the codebooks; each search starts at the entry of the round before."""
    code = np.zeros(x.shape[:2], np.int64)
    for book in books:
        code, d = book.nearest(x, code)
    return code, d


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, codes, error, codebooks_sha256) for each kept row of (vec_id, embedding, label).

    Each component becomes floor(256 x). A vector is cut into ``parts`` equal parts; each part's codebook
    starts as that part of the ``entries`` smallest kept ids and takes part in ``rounds`` of k-means with floored
    means. What a round needs of the rows before it is their last entry, and that follows from the earlier codebooks,
    which are small: a task passes each row through all of them, so no table of codes is written or
    joined between rounds. Tasks return sums and counts of each entry alone: parts x entries rows.

    Rows without a vector or with a null, NaN or infinite component are dropped. The length is that of the
    kept row with the smallest id whose length is a positive multiple of ``parts`` (of equal ids, the smallest
    vector); rows of other lengths are dropped too. Components beyond 131,072 count as that bound. With
    fewer rows than entries, codebooks have as many entries as rows. Null ids come last; repeated rows are
    kept. Other columns are ignored. No kept row, no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), "label").where("v IS NOT NULL")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0) & finite)
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = usable.orderBy(*by_id).limit(1).select(F.size("v")).first()
    schema = "vec_id long, label string, codes binary, error long"
    kind = dict(rows.dtypes)["label"]
    if first is None:
        return spark.createDataFrame([], schema).select("vec_id", F.col("label").cast(kind), "codes", "error", F.lit("").alias("codebooks_sha256"))
    width = first[0]
    smallest = usable.where(F.size("v") == width).orderBy(*by_id).limit(entries).select("v").collect()
    _, x = whole_numbers(pa.array([r[0] for r in smallest], pa.list_(pa.float64())), width)
    books = [Codebooks(x.reshape(len(x), parts, -1).transpose(1, 0, 2))]
    for _ in range(rounds):
        books.append(moved(rows, books, width))
    held = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                kept, x = whole_numbers(batch.column(1), width)
                code, d = codes_of(x.reshape(len(x), parts, width // parts), held.value)
                some = batch.take(pa.array(kept))
                codes = pa.array([c.tobytes() for c in code.astype(np.uint8 if entries <= 256 else np.uint16)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), codes, pa.array(d.sum(axis=1))], ["vec_id", "label", "codes", "error"])

    coded = rows.select("vec_id", "v", F.col("label").cast("string").alias("label")).mapInArrow(encode, schema)
    return coded.select("vec_id", F.col("label").cast(kind).alias("label"), "codes", "error", F.lit(books[-1].digest()).alias("codebooks_sha256"))


def moved(rows: DataFrame, books: list[Codebooks], width: int) -> Codebooks:
    """The codebooks after one more round: floored means of each entry's parts; an entry without any stays."""
    old = books[-1].entries
    parts, n_entries, size = old.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n_entries, size), np.int64), np.zeros(parts * n_entries, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                _, x = whole_numbers(whole.column(0).slice(at, 2048), width)
                x = x.reshape(len(x), parts, size)
                code, _ = codes_of(x, held.value)
                flat = (code + np.arange(parts) * n_entries).reshape(-1)
                np.add.at(sums, flat, x.reshape(-1, size))
                counts += np.bincount(flat, minlength=len(counts))
        used = np.flatnonzero(counts)
        # component -1 carries the count
        table = np.concatenate([counts[used, None], sums[used]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size + 1)), pa.array(np.tile(np.arange(-1, size), len(used))), pa.array(table.reshape(-1))], ["entry", "i", "x"])

    sums = rows.select("v").mapInArrow(total, "entry long, i long, x long").groupBy("entry", "i").agg(F.sum("x").alias("x"))
    new = old.reshape(parts * n_entries, size).copy()
    found = {(r[0], r[1]): r[2] for r in sums.collect()}  # parts x entries x (components + 1) numbers
    for (entry, i), x in found.items():
        if i >= 0:
            new[entry, i] = x // found[entry, -1]
    return Codebooks(new.reshape(old.shape))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over rows of the same label; null is a label too.

    Sums are formed within tasks before they are shuffled. Few labels' sums are broadcast; where there are more than
    ``FEW_LABELS``, each label's rows are dealt to ``LABEL_PARTS`` parts, so a frequent one isn't one task's work.
    """
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "__label")
    sums = materialise(sums, "label-sums")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same).drop("__label")
    dealt = coded.withColumn("__part", F.pmod(F.xxhash64("vec_id"), F.lit(LABEL_PARTS)))
    copies = sums.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(LABEL_PARTS - 1))))
    return dealt.join(copies, same & (F.col("__part") == F.col("__of"))).drop("__label", "__part", "__of")


def code_digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes in hex, two digits a part."""
    coded = materialise(compress_vectors(vectors), "codes")
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")
