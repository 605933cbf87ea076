"""Reading and writing headerless little-endian float32 matrices."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class RowRange(InputPartition):
    first: int
    last: int

    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def _open(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), os.path.abspath(path))


class Float32Reader(DataSourceReader):
    """Row ranges of the file are partitions; each reads its own bytes only."""

    def __init__(self, path: str, dimension: int, rows: int) -> None:
        self.path, self.dimension, self.rows = path, dimension, rows
        fs, name = _open(path)
        self.size = fs.get_file_info(name).size

    def partitions(self) -> list[InputPartition]:
        width = 4 * self.dimension
        if self.size % width:
            raise ValueError(f"{self.path} holds no whole number of rows of dimension {self.dimension}")
        total = self.size // width
        return [RowRange(i, min(total, i + self.rows)) for i in range(0, total, self.rows)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        width, step = 4 * self.dimension, max(1, (8 << 20) // (4 * self.dimension))
        fs, name = _open(self.path)
        with fs.open_input_file(name) as f:
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                flat = np.frombuffer(f.read_at(n * width, first * width), "<f4")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.dimension)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))], names=["row", "vector"])


class Float32Source(DataSource):
    """spark.read.format("float32le").option("dimension", d).load(path): row bigint, vector array<float>."""

    @classmethod
    def name(cls) -> str:
        return "float32le"

    def schema(self) -> str:
        return "row bigint, vector array<float>"

    def reader(self, schema: object) -> DataSourceReader:
        return Float32Reader(self.options["path"], int(self.options["dimension"]), int(self.options.get("rows", 65536)))


def read_float32(spark: SparkSession, path: str, dimension: int, rows_per_partition: int = 65536) -> DataFrame:
    """The rows of a vector shard, in as many partitions as its size asks for."""
    spark.dataSource.register(Float32Source)
    return spark.read.format("float32le").option("dimension", dimension).option("rows", rows_per_partition).load(path)


def rows_of_payload(payload: str, dimension: str, row: str):
    """A column: the vector at a row number of a payload column, null if the row is negative or beyond the payload."""
    @F.pandas_udf("array<float>")
    def cut(data: pd.Series, dim: pd.Series, at: pd.Series) -> pd.Series:
        def one(d: object, n: object, r: object) -> object:
            if d is None or pd.isna(n) or pd.isna(r) or n <= 0 or r < 0 or (int(r) + 1) * int(n) * 4 > len(d):
                return None
            return np.frombuffer(d, "<f4", int(n), int(r) * int(n) * 4)

        return pd.Series([one(*x) for x in zip(data, dim, at)], dtype=object)

    return cut(F.col(payload), F.col(dimension), F.col(row))


def write_float32(df: DataFrame, path: str, order: str = "row", vector: str = "vector") -> int:
    """Writes vectors in order as one headerless file; gives its size. The target must not exist.

    Executors pack rows to bytes; the driver only appends the parts, one partition at a time.
    """
    if os.path.exists(path):
        raise FileExistsError(path)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), "<f4")
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["data"])

    parts = df.orderBy(order).select(vector).mapInArrow(pack, "data binary")
    part = path + ".part"
    with open(part, "wb") as f:
        for r in parts.toLocalIterator():
            f.write(r["data"])
    os.replace(part, path)
    return os.path.getsize(path)
