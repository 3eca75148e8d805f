"""Binary formats: matrices with an HKDT header, lists of 32-bit edges, and Parquet edge tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.matrix import SparseMatrix

# Fixed values of the format: magic, then version, object size, format, rows, columns, entries.
MAGIC, HEADER = b"HKDT", "<4s6Q"
INDEX = 8


def parse_header(data: bytes) -> dict[str, int]:
    if len(data) < struct.calcsize(HEADER) or data[:4] != MAGIC:
        raise ValueError("no HKDT header")
    return dict(zip(("version", "objsize", "format", "nrow", "ncol", "nnz"), struct.unpack_from(HEADER, data)[1:], strict=True))


def header_bytes(nrow: int, ncol: int, nnz: int, objsize: int = 8) -> bytes:
    return struct.pack(HEADER, MAGIC, 1, objsize, 0, nrow, ncol, nnz)


def read_hkdt(spark: SparkSession, path: str, value: str = "<f8", transpose: bool = False, duplicates: str = "sum") -> SparseMatrix:
    """Files of (row, col, val) records after an HKDT header, indices of 8 bytes from 0; each file is a task's, of up to 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    size = parse_header(bytes(files.select(F.substring("content", 1, struct.calcsize(HEADER)).alias("h")).first()["h"]))
    record = np.dtype([("row", "<i8"), ("col", "<i8"), ("val", value)])
    kind = "long" if np.dtype(value).kind in "iu" else "double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                r = np.frombuffer(content, record, parse_header(content)["nnz"], struct.calcsize(HEADER))
                for i in range(0, len(r), 100_000):
                    s = r[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(s["row"]), pa.array(s["col"]), pa.array(s["val"].astype("i8" if kind == "long" else "f8"))], ["row", "col", "val"])

    df = files.select("content").mapInArrow(read, f"row long, col long, val {kind}")
    m = SparseMatrix.build(df, size["nrow"], size["ncol"], duplicates)
    return m.transpose() if transpose else m


def write_hkdt(matrix: SparseMatrix, path: str, value: str = "<f8") -> int:
    """Files of (row, col, val) records after an HKDT header, one of each partition, into a new folder; how many entries."""
    from pyarrow import fs

    nrow, ncol, record = matrix.nrow, matrix.ncol, np.dtype([("row", "<i8"), ("col", "<i8"), ("val", value)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        where.create_dir(folder, recursive=True)
        task, records = TaskContext.get(), []
        name = f"{folder}/part-{task.partitionId():05d}"
        for b in batches:
            r = np.empty(b.num_rows, record)
            for k, c in enumerate(("row", "col", "val")):
                r[c] = b.column(k).to_numpy(zero_copy_only=False)
            records.append(r)
        n = sum(map(len, records))
        with where.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            out.write(header_bytes(nrow, ncol, n))
            for r in records:
                out.write(r.tobytes())
        where.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return matrix.df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of files of unsigned 32-bit pairs; repeats and loops stay."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                pairs = np.frombuffer(content, "<u4", len(content) // 8 * 2).reshape(-1, 2).astype(np.int64)
                for i in range(0, len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, k]) for k in (0, 1)], ["src", "dst"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "src long, dst long")


def write_edge_list(edges: DataFrame, path: str) -> int:
    """(src, dst) as files of unsigned 32-bit pairs, one of each partition, into a new folder; how many pairs.

    Each task writes under a name of its own and renames it when done, so a task that runs twice leaves one file.
    """
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        where.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name, n = f"{folder}/part-{task.partitionId():05d}", 0
        with where.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            for b in batches:
                pairs = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
                if len(pairs) and (pairs.min() < 0 or pairs.max() > 0xFFFFFFFF):
                    raise ValueError("vertices have to be unsigned 32-bit numbers")
                out.write(pairs.astype("<u4").tobytes())
                n += len(pairs)
        where.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


#: Entries of a file of an edge table, about.
FILE_ROWS = 4_000_000


def write_edges(matrix: SparseMatrix, path: str, file_rows: int = FILE_ROWS) -> None:
    """The matrix as a Parquet edge table, partitioned by value (the predicate), so that a pattern reads its predicates only.

    Entries are dealt by ranges of (val, row), so that a predicate with a third of all edges is as many tasks and files as it needs.
    """
    df = matrix.df
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // file_rows)
    df.repartitionByRange(parts, "val", "row").sortWithinPartitions("val", "row", "col").write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("val").parquet(path)


def read_edges(spark: SparkSession, path: str, nrow: int, ncol: int) -> SparseMatrix:
    return SparseMatrix(spark.read.parquet(path), nrow, ncol)
