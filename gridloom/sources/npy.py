"""Arrays of numpy's .npy files as tables, read by row ranges."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition unless the option says otherwise, rows of an Arrow batch.
ROWS, BATCH = 100_000, 4096
KINDS = {"f4": "float", "f8": "double", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint"}


@dataclass
class Header:
    """Type and shape of the array, and where its first row begins in the file."""

    dtype: np.dtype
    shape: tuple[int, ...]
    at: int


def opened(path: str):
    """A file of any store that pyarrow knows, for reading at places."""
    from pyarrow import fs

    if path.startswith("file:"):
        store, inside = fs.LocalFileSystem(), unquote(urlsplit(path).path)
    else:
        store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


def header(path: str) -> Header | None:
    """The file's header, None where there is no file; an error for what isn't a plain two-dimensional array in row order."""
    try:
        with opened(path) as f:
            magic = f.read(8)
            if magic[:6] != b"\x93NUMPY":
                raise ValueError(f"{path} is no .npy file")
            wide = 2 if magic[6] == 1 else 4
            size = int.from_bytes(f.read(wide), "little")
            told = ast.literal_eval(f.read(size).decode("utf-8" if magic[6] >= 3 else "latin1"))
    except FileNotFoundError:
        return None
    if not isinstance(told["descr"], str) or told["descr"][1:] not in KINDS:
        raise ValueError(f"{path} holds {told['descr']}, not plain numbers")  # objects would need a pickle
    if told["fortran_order"] and min(told["shape"], default=0) > 1:
        raise ValueError(f"{path} is in column order")
    return Header(np.dtype(told["descr"]), tuple(told["shape"]), 8 + wide + size)


@dataclass
class _Rows(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, rows: int, found: Header):
        self.path, self.rows, self.found = path, rows, found

    def partitions(self) -> list[_Rows]:
        n = self.found.shape[0]
        return [_Rows(a, min(a + self.rows, n)) for a in range(0, max(n, 1), self.rows)]

    def read(self, partition: _Rows) -> Iterator:
        import pyarrow as pa

        width, kind = self.found.shape[1], self.found.dtype
        size = width * kind.itemsize
        with opened(self.path) as f:
            for a in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                f.seek(self.found.at + a * size)
                data = f.read(n * size)
                if len(data) < n * size:
                    raise ValueError(f"{self.path} ends before row {a + n}")
                flat = np.frombuffer(data, kind).astype(kind.newbyteorder("="))
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), held], names=["row", "vector"])


class NpySource(DataSource):
    """Format npy: row (from 0) and vector of each row of a two-dimensional array; option rows is how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _header(self) -> Header:
        found = header(self.options["path"])
        if found is None:
            raise FileNotFoundError(self.options["path"])
        if len(found.shape) != 2:
            raise ValueError(f"{self.options['path']} has {len(found.shape)} dimensions, not two")
        return found

    def schema(self) -> str:
        return f"row bigint, vector array<{KINDS[self._header().dtype.str[1:]]}>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rows", ROWS)), self._header())


def vectors(spark: SparkSession, path: str, width: int, vector: str = "vector", rows: int = ROWS) -> DataFrame | None:
    """row and the vectors of an array, or None, and so to be made anew, if there is none or its rows have another width."""
    found = header(path)
    if found is None or len(found.shape) != 2 or found.shape[1] != width:
        return None
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("rows", str(rows)).load(path).withColumnRenamed("vector", vector)
