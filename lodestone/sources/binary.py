"""Matrices in files with a header of two int32 (rows, columns) and row-major 4-byte values.

Reading is a data source: the header alone is read for the plan, and every partition seeks to
its own block of rows, so files of any size are read in parallel. Paths must be open to the
driver and the executors alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = 8
ROWS = 65_536


def header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        head = np.frombuffer(f.read(HEADER), "<i4")
    if len(head) != 2 or (head < 0).any():
        raise ValueError(f"{path} has no header of two counts")
    return int(head[0]), int(head[1])


def read_block(path: str, columns: int, start: int, count: int, kind: str) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(HEADER + start * columns * 4)
        data = np.frombuffer(f.read(count * columns * 4), kind)
    if len(data) != count * columns:
        raise ValueError(f"{path} ends before row {start + count}")
    return data.reshape(count, columns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.kind = options["path"].removeprefix("file://"), kind
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        n, _ = header(self.path)
        return [InputPartition((a, min(self.rows, n - a))) for a in range(0, n, self.rows)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, count = partition.value
        _, columns = header(self.path)
        x = read_block(self.path, columns, start, count, self.kind)
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, columns), dtype=np.int32)[: count + 1], x.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + count)), lists], names=["id", "vec"])


class FloatMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options, "<f4")


class IntMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ibin"

    def schema(self) -> str:
        return "id long, vec array<int>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options, "<i4")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FloatMatrix)
    spark.dataSource.register(IntMatrix)


def write_matrix(rows: DataFrame, path: str, id_column: str, vec_column: str, kind: str = "<f4") -> None:
    """Write rows, in order of id, as one file on the driver, a partition at a time."""
    ordered = rows.select(id_column, vec_column).orderBy(id_column)
    n, columns, partial = 0, 0, f"{path}.partial"
    with open(partial, "wb") as f:
        f.write(bytes(HEADER))
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            x = np.asarray(row[1], kind)
            if n and len(x) != columns:
                raise ValueError("rows differ in length")
            columns, n = len(x), n + 1
            f.write(x.tobytes())
        f.seek(0)
        f.write(np.array([n, columns], "<i4").tobytes())
    os.replace(partial, path)


def long_form(matrix: DataFrame, key: str = "qid", value: str = "base_id") -> DataFrame:
    """(key, rank from 1, value): an int matrix with a row for each entry."""
    return matrix.selectExpr(f"id as {key}", "posexplode(vec) as (pos, x)").selectExpr(key, "cast(pos + 1 as long) as rank", f"cast(x as long) as {value}")
