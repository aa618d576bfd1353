"""Best-fit packing of token pieces into fixed-size sequences.

Bounded-space online best-fit: a fixed number of bins is open at a time, and a bitset holds
which amounts of free space some open bin has. The bin with the least sufficient space takes a
piece; when no bin fits and none may be opened, the fullest one closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import tasks_for, text_of
from nearlake.llm.encoding import MEMO_WORDS, Encoder

CAPACITY = 1024
OPEN_BINS = 4096
#: Pieces of the stream that are looked at together.
AHEAD = 2048
ROWS_PER_TASK = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SEQUENCE_BITS = 40

_encoders: dict[str, Encoder] = {}


def encoder(path: str, words: int = MEMO_WORDS) -> Encoder:
    """One encoder for each worker process: its memos, of at most so many words, outlive a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, words)
    found = _encoders[path]
    found.word.limit = found.piece.limit = words
    return found


class OpenBins:
    """Open bins keyed by free space; bit f of ``free`` is set when some bin has f left."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.n_open, self.n_bins = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        found = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the place in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.n_open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            chosen, space = self.n_bins, self.capacity
            self.n_bins += 1
        left = space - length
        if left:
            self.by_space[left].append(chosen)
            self.free |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - space


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Token pieces of at most ``capacity`` ids; only a longer document is cut, its first piece takes the rest.

    Null and empty texts give one piece that holds the end id alone.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memo_words).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at, stop = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    part = ids[4 * at : 4 * stop]
                    rows.append((doc_id, k, at, stop - at, zlib.crc32(part), *((part,) if with_ids else ())))
                    at, stop = stop, stop + capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = [f.split()[0] for f in schema.split(", ")]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, schema)


def pack(cut: DataFrame, n_tasks: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, ahead: int = AHEAD) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    Pieces are dealt to ``n_tasks`` tasks by a hash and arrive in hash order, so each task packs
    a random stream with bins of its own; a task run again repeats its result. Within each
    ``ahead`` pieces of the stream the longest come first, which leaves less space unused; the
    open bins outnumber them, so they don't close before the short pieces come.
    """

    def best_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << _SEQUENCE_BITS
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            placed: list = [None] * len(lengths)
            for at in range(0, len(lengths), ahead):
                block = range(at, min(at + ahead, len(lengths)))
                for i in sorted(block, key=lambda i: -lengths[i]):  # ties stay in order
                    placed[i] = bins.place(lengths[i])
            sequence = pa.array([base + s for s, _ in placed], pa.int64())
            offset = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, sequence, offset], [*batch.schema.names, "sequence_id", "offset"]
            )

    order = F.xxhash64("doc_id", "piece")
    dealt = cut.repartition(n_tasks, order).sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return dealt.mapInArrow(best_fit, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    rows_per_task: int = ROWS_PER_TASK,
    with_ids: bool = False,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and offset.

    Every row of ``docs`` is packed, repeated rows and equal ids too. Columns other than
    ``doc_id`` and ``text`` are not read. An empty table gives no rows. ``with_ids`` adds the
    ids of each piece as little-endian unsigned 32-bit integers. There is a task for every ``rows_per_task``
    pieces that are expected: a document gives one, and another for every 2 * capacity bytes, as tokens have
    two bytes or more but for rare texts. ``memo_words`` bounds the words whose ids a worker remembers; it
    changes no result.
    """
    cut = pieces(docs, tokenizer, end_id, capacity, with_ids, memo_words)
    expected = docs.agg(F.sum(1 + F.floor(F.octet_length(text_of()) / (2 * capacity)))).first()[0] or 0
    return pack(cut, tasks_for(expected, rows_per_task), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order, from pieces packed ``with_ids``: at most ``capacity`` of them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), ""))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
