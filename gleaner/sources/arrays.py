"""A batch source of .npy files: one-dimensional arrays as (id, x), matrices as (id, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Chunk(InputPartition):
    def __init__(self, path: str, first: int, start: int, stop: int):
        self.path, self.first, self.start, self.stop = path, first, start, stop


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[InputPartition]:
        found, first = [], 0
        for path in self.paths:
            n = len(np.load(path, mmap_mode="r"))
            found += [_Chunk(path, first, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
            first += n
        return found

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        part = np.load(partition.path, mmap_mode="r")[partition.start : partition.stop]
        at = partition.first + partition.start
        for i, row in enumerate(part):
            yield (at + i, float(row)) if part.ndim == 1 else (at + i, [float(x) for x in row])


class NpyDataSource(DataSource):
    """Options: paths (comma-separated, on a mounted file system), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _paths(self) -> list[str]:
        return [p for p in (self.options.get("paths") or self.options["path"]).split(",") if p]

    def schema(self) -> str:
        return "id long, x double" if np.load(self._paths()[0], mmap_mode="r").ndim == 1 else "id long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._paths(), int(self.options.get("rows", "100000")))


def read_npy(spark: SparkSession, paths: list[str], rows: int = 100_000) -> DataFrame:
    """Rows of the arrays, one file after the other, cut into partitions that are mapped into memory."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("paths", ",".join(paths)).option("rows", rows).load()
