"""The binary sparse-vector format as a Spark data source, and its writer.

Little-endian: a count of vectors, then for each vector its number of components, the components (32-bit
unsigned) and the values (32-bit floats).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id bigint, components array<int>, values array<float>"


class Range(InputPartition):
    def __init__(self, first: int, count: int, at: int):
        super().__init__((first, count, at))
        self.first, self.count, self.at = first, count, at


class SparseVectors(DataSource):
    """``spark.read.format("sparse_vectors").load(path)``; options: ``limit`` vectors, ``split`` vectors a task.

    The path is a file that the driver and all executors can open; for files that only Spark's file systems
    reach, use :func:`read_through_spark`.
    """

    @classmethod
    def name(cls) -> str:
        return "sparse_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("limit", -1))
        self.split = int(options.get("split", 100_000))

    def partitions(self) -> list[Range]:
        """One skip through the vector headers; the values aren't read."""
        with open(self.path, "rb") as f:
            (n,) = struct.unpack("<I", f.read(4))
            n = n if self.limit < 0 else min(n, self.limit)
            out, at = [], 4
            for first in range(0, n, self.split):
                out.append(Range(first, min(self.split, n - first), at))
                for _ in range(out[-1].count):
                    f.seek(at)
                    (nnz,) = struct.unpack("<I", f.read(4))
                    at += 4 + 8 * nnz
            return out or [Range(0, 0, 4)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(partition.at)
            for i in range(partition.first, partition.first + partition.count):
                (nnz,) = struct.unpack("<I", f.read(4))
                components = np.frombuffer(f.read(4 * nnz), "<u4")
                values = np.frombuffer(f.read(4 * nnz), "<f4")
                yield i, components.tolist(), values.tolist()


def read_binary(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(SparseVectors)
    reader = spark.read.format("sparse_vectors")
    return (reader if limit is None else reader.option("limit", limit)).load(path)


def read_through_spark(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One or more whole files by Spark's file systems, a file a task; ids count up within each file."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                (n,) = struct.unpack_from("<I", content, 0)
                at, rows = 4, []
                for i in range(n if limit is None else min(n, limit)):
                    (nnz,) = struct.unpack_from("<I", content, at)
                    rows.append((name, i, np.frombuffer(content, "<u4", nnz, at + 4).astype("int32"), np.frombuffer(content, "<f4", nnz, at + 4 + 4 * nnz)))
                    at += 4 + 8 * nnz
                yield pd.DataFrame(rows, columns=["file", "doc_id", "components", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {SCHEMA}")


def write_binary(docs: DataFrame, path: str) -> int:
    """Write vectors in order of their ids through the driver, one at a time; returns their number. A file format
    with one leading count has one writer; for large corpora keep the Parquet tables."""
    n = 0
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(struct.pack("<I", 0))
        for r in docs.orderBy("doc_id").select("components", "values").toLocalIterator():
            f.write(struct.pack("<I", len(r[0])) + np.array(r[0], "<u4").tobytes() + np.array(r[1], "<f4").tobytes())
            n += 1
        f.seek(0)
        f.write(struct.pack("<I", n))
    return n


def truncate(spark: SparkSession, path: str, out: str, n: int) -> int:
    """The first n vectors of a file."""
    return write_binary(read_binary(spark, path, n), out)
