"""Binary vector files: ``.bin`` (a header, then rows) and ``vecs`` (a dimension before each row).

Files are read in ranges, one task each, so a file may be larger than a task's memory. Paths are
URIs of file systems that pyarrow knows, or local paths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"float32": ("<f4", "float"), "int8": ("i1", "tinyint"), "uint8": ("u1", "smallint"), "int16": ("<i2", "smallint"), "int32": ("<i4", "int"), "uint32": ("<u4", "long")}
RANGE_BYTES = 32 << 20


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset the warehouse, on one machine alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/vectors-{uuid.uuid4().hex}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _type(name: str) -> tuple[np.dtype, str]:
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}; known: {', '.join(TYPES)}")
    return np.dtype(TYPES[name][0]), TYPES[name][1]


def _read_ranges(spark: SparkSession, path: str, n: int, start: int, record: int, skip: int, dim: int, kind: np.dtype, sql: str) -> DataFrame:
    per = max(1, RANGE_BYTES // record)
    tasks = -(-n // per)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, count = k * per, min(per, n - k * per)
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    data = np.frombuffer(f.read_at(count * record, start + first * record), np.uint8).reshape(count, record)
                v = np.ascontiguousarray(data[:, skip:]).view(kind).reshape(count, dim)
                values = pa.array(v.ravel()).cast({"float": pa.float32(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64()}[sql])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, count * dim + 1, dim), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), lists], ["id", "v"])

    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(read, f"id long, v array<{sql}>")


def read_bin(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(id, v): ids are places. The header is the numbers of rows and of dimensions, 32 bits each."""
    kind, sql = _type(dtype)
    system, name = _open(path)
    with system.open_input_file(name) as f:
        n, dim = np.frombuffer(f.read(8), "<i4").tolist()
        if f.size() < 8 + n * dim * kind.itemsize:
            raise ValueError("the file is shorter than its header says")
    return _read_ranges(spark, path, n, 8, dim * kind.itemsize, 0, dim, kind, sql)


def read_vecs(spark: SparkSession, path: str, dtype: str = "float32") -> DataFrame:
    """(id, v) of an fvecs, ivecs or bvecs file, all rows of one dimension."""
    kind, sql = _type(dtype)
    system, name = _open(path)
    with system.open_input_file(name) as f:
        size = f.size()
        if not size:
            return spark.createDataFrame([], f"id long, v array<{sql}>")
        dim = int(np.frombuffer(f.read(4), "<i4")[0])
    record = 4 + dim * kind.itemsize
    if size % record:
        raise ValueError("the file isn't a whole number of rows")
    return _read_ranges(spark, path, size // record, 0, record, 4, dim, kind, sql)


def write_shards(rows: DataFrame, folder: str, dtype: str = "float32", vecs: bool = False) -> DataFrame:
    """Write (id, v) with a file of vectors and a file of 32-bit ids per partition; returns (shard, path, n).

    Names hold the attempt, so a task that runs again leaves the files of the run that counted.
    """
    kind, _ = _type(dtype)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                parts.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1))
        if not ids:
            return
        v, i = np.concatenate(parts), np.concatenate(ids).astype("<u4")
        task = TaskContext.get()
        stem = f"{folder}/shard-{task.partitionId():05d}-{task.taskAttemptId()}"
        system, name = _open(stem)
        if isinstance(system, fs.LocalFileSystem):
            system.create_dir(name.rpartition("/")[0], recursive=True)
        n, dim = v.shape
        with system.open_output_stream(f"{name}.{'vecs' if vecs else 'bin'}") as f:
            if vecs:
                head = np.full((n, 1), dim, "<i4").view(np.uint8)
                f.write(np.concatenate([head.reshape(n, 4), v.view(np.uint8).reshape(n, -1)], axis=1).tobytes())
            else:
                f.write(np.array([n, dim], "<i4").tobytes() + v.tobytes())
        with system.open_output_stream(f"{name}_ids_uint32.bin") as f:
            f.write(np.array([n, 1], "<i4").tobytes() + i.tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": stem, "n": n}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n", pa.int64())]))

    out = rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(write, "shard int, path string, n long")
    return rows.sparkSession.createDataFrame(out.collect(), "shard int, path string, n long")  # a row per file
