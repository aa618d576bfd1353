"""Token ids as flat binary files that can be memory-mapped.

Each task of a range partitioning by document id writes two files to the shared folder:
``part-N.bin`` holds the ids of its documents one after another as unsigned integers (16 bits
where the vocabulary allows it, else 32), ``part-N.idx`` the document ids and the 64-bit offsets
of their first ids. Prefix sums over the counts of the parts give each part's base, so any
document's place in the whole stream is its base and its offset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearlake.llm.common import materialise, partitions, shared_dir, text_of
from nearlake.llm.packing import encoder

MANIFEST = "part int, path string, width int, n_docs long, n_tokens long"
#: Fixed value: first bytes of an index file.
MAGIC = b"TOKENIDX"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _index_bytes(doc_ids: list[int | None], offsets: np.ndarray, width: int) -> bytes:
    """Rows without an id come first, so their number tells them from rows of any id."""
    nameless = sum(d is None for d in doc_ids)
    head = np.array([width, len(doc_ids), nameless], "<i8").tobytes()
    return MAGIC + head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + offsets.astype("<i8").tobytes()


def read_index(data: bytes) -> tuple[int, np.ma.MaskedArray, np.ndarray]:
    """Bytes per id, document ids (masked where a row has none), and offsets (one more than documents)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token index")
    width, n, nameless = np.frombuffer(data, "<i8", 3, 8).tolist()
    numbers = np.frombuffer(data, "<i8", 2 * n + 1, 32)
    return width, np.ma.masked_array(numbers[:n], np.arange(n) < nameless), numbers[n:]


def map_ids(path: str, width: int, n: int) -> np.ndarray:
    """The ids of one part: memory-mapped on a file system that can, else read."""
    kind = np.dtype(f"<u{width}")
    if n == 0:
        return np.empty(0, kind)
    system, name = _open(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, kind, "r", shape=(n,))
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the manifest with each part's base.

    Null and empty texts hold the end id alone. Rows with equal ids are all kept, ordered by a
    hash of their texts; rows without an id come first. A task that runs again writes files of another name, and the manifest
    names only those of the run that counted. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    parts = partitions(spark, docs.count())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        width = 2 if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        system, name = _open(stem)
        doc_ids: list[int] = []
        lengths: list[int] = []
        out = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(encode.encode(text.as_py()) + end, "<u4")
                if out is None:
                    if isinstance(system, fs.LocalFileSystem):
                        system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(f"{name}.bin")
                out.write(ids.astype(f"<u{width}").tobytes())
                doc_ids.append(doc_id)
                lengths.append(len(ids))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        with system.open_output_stream(f"{name}.idx") as f:
            f.write(_index_bytes(doc_ids, offsets, width))
        row = {"part": task.partitionId(), "path": stem, "width": width, "n_docs": len(doc_ids), "n_tokens": int(offsets[-1])}
        types = [("part", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
        yield pa.RecordBatch.from_pylist([row], pa.schema(types))

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "manifest")
    before = F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: its first id's place in the stream, its ids' number and crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _open(row["path"])
                with system.open_input_file(f"{name}.idx") as f:
                    width, doc_ids, offsets = read_index(f.read())
                ids = map_ids(f"{row['path']}.bin", width, int(offsets[-1]))
                ends = offsets.tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.data, mask=doc_ids.mask), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return manifest.repartition(parts, "part").mapInArrow(read, schema)
