"""Fixed-length binary token records and NumPy index vectors, read and written by ranges."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from echotrace.sources.ranges import CHUNK, RANGE, ByteRange, chunks, file_system, files_of, ranges_of


class TokenRecords(DataSource):
    """Records of `length` 32-bit ids, numbered over all files in order of their names; `skip` first ids of each are left out."""

    @classmethod
    def name(cls) -> str:
        return "echotrace_token_records"

    def schema(self) -> str:
        return "index long, tokens array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options)


class _TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length, self.skip = options["path"], int(options["length"]), int(options["skip"])
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[ByteRange]:
        out, first, size = [], 0, 4 * self.length
        for path, n in files_of(self.path):
            if n % size:
                raise ValueError(f"{path} has {n} bytes, which isn't a number of records of {size}")
            out += ranges_of(path, size, 0, n, first, self.range)
            first += n // size
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        for first, raw in chunks(part, 4 * self.length):
            ids = np.frombuffer(raw, dtype="<i4").reshape(-1, self.length)[:, self.skip :]
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1]
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(ids).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(ids))), tokens], ["index", "tokens"])


class IndexVectors(DataSource):
    """One-dimensional .npy files: path, pos and value."""

    @classmethod
    def name(cls) -> str:
        return "echotrace_index_vectors"

    def schema(self) -> str:
        return "path string, pos long, value long"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options)


def vector_header(path: str) -> tuple[np.dtype, int, int]:
    """Type, number and first byte of the elements of a .npy file."""
    system, at = file_system(path)
    with system.open_input_file(at) as source:
        head = io.BytesIO(source.read_at(min(source.size(), 1 << 16), 0))
    version = np.lib.format.read_magic(head)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 1 or dtype.kind not in "iu":
        raise ValueError(f"{path} isn't a vector of integers")
    return dtype, shape[0], head.tell()


class _VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range", RANGE))

    def partitions(self) -> list[ByteRange]:
        out = []
        for path, _ in files_of(self.path):
            dtype, n, begin = vector_header(path)
            out += ranges_of(path, dtype.itemsize, begin, begin + n * dtype.itemsize, 0, self.range)
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        dtype = vector_header(part.path)[0]
        for first, raw in chunks(part, dtype.itemsize, CHUNK):
            values = np.frombuffer(raw, dtype=dtype).astype(np.int64)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(values), dtype=np.int32)), [part.path]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(first + np.arange(len(values))), pa.array(values)], ["path", "pos", "value"])


def _rows(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def read_token_records(spark: SparkSession, path: str, length: int = 8192, drop_first: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """index and tokens of each record of `length` 32-bit ids; the first id, a begin sign, is dropped.

    path: a file, a folder or a glob in the last part. Files are cut at record borders, so one large file is read by many tasks.
    """
    return _rows(spark, TokenRecords, path=path, length=length, skip=int(drop_first), range=range_bytes)


def read_index_vectors(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """path, pos (in its file) and value of one-dimensional .npy files of integers; a file is read by many tasks."""
    return _rows(spark, IndexVectors, path=path, range=range_bytes)


def index_hash(spark: SparkSession, folder: str, suffix: str) -> str:
    """What stands before the first "-" in the name of the first file with the suffix; an error if there is none."""
    names = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    first = names.where(F.endswith(F.col("name"), F.lit(suffix))).agg(F.min("name")).first()[0]
    if first is None:
        raise ValueError(f"no file in {folder} ends with {suffix}")
    return first.split("-")[0]
