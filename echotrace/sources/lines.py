"""Keyed access to lines of text files: an index of where every so-many-th line begins, and reads by seek.

Files are lines in order of their names. The index has 8 bytes for every `every`-th line of a file, made by Spark in two passes over
byte ranges (counts of lines, then, with their sums, offsets), and a small description of the files. A line is found by one
read in the index and a few of at most BLOCK bytes in the file, however large both are.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.window import Window

from echotrace.sources.ranges import RANGE, ByteRange, chunks, file_system, files_of, ranges_of
from echotrace.sources.shared import broadcast_if_small, stored
from echotrace.sources.sinks import write_bytes

#: Every so many lines have an entry; bytes that are read at once from there on.
EVERY, BLOCK = 64, 1 << 16


def line_starts(part: ByteRange) -> Iterator[np.ndarray]:
    """Offsets of the lines that begin in a range: behind a line break, or with the file."""
    system, at = file_system(part.path)
    with system.open_input_file(at) as source:
        size = source.size()
    if part.start == 0 and size:
        yield np.zeros(1, dtype=np.int64)
    before = ByteRange(part.path, max(part.start - 1, 0), part.stop - 1, max(part.start - 1, 0))
    for first, raw in chunks(before, 1):
        at = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + first + 1
        yield at[at < size]


class LineRanges(DataSource):
    """path, start, stop and n_lines of the byte ranges of files: how many lines begin in each."""

    @classmethod
    def name(cls) -> str:
        return "echotrace_line_ranges"

    def schema(self) -> str:
        return "path string, start long, stop long, n_lines long"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options["range"])

    def partitions(self) -> list[ByteRange]:
        return [r for path, n in files_of(self.path) for r in ranges_of(path, 1, 0, n, 0, self.range)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        n = sum(len(x) for x in line_starts(part))
        yield pa.RecordBatch.from_pylist([{"path": part.path, "start": part.start, "stop": part.stop, "n_lines": n}])


def _offsets(every: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                line = r["first"]
                for starts in line_starts(ByteRange(r["path"], r["start"], r["stop"])):
                    some = np.arange((-line) % every, len(starts), every)
                    entries = r["entry"] + (line + some) // every
                    line += len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array(starts[some])], ["entry", "offset"])

    return work


def _entry_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        first, n, out, name = None, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.column(0)[0].as_py()
                name = f"{at}/entries-{first:015d}"
                out = system.open_output_stream(f"{name}.tmp")
            out.write(batch.column(1).to_numpy().astype("<i8").tobytes())
            n += batch.num_rows
        if out is not None:
            out.close()
            system.move(f"{name}.tmp", f"{name}.idx")
            yield pa.RecordBatch.from_pylist([{"first": first, "n": n}])

    return write


def write_line_index(spark: SparkSession, path: str, folder: str, every: int = EVERY, range_bytes: int = RANGE) -> int:
    """Writes the index of the files at path (a file, a folder or a glob) to folder; returns the number of lines."""
    spark.dataSource.register(LineRanges)
    parts = stored(spark.read.format(LineRanges.name()).options(path=path, range=range_bytes).load(), "ranges")
    found = {r["path"]: r["n"] for r in parts.groupBy("path").agg(F.sum("n_lines").alias("n")).collect()}  # a row for each file
    files, line, entry = [], 0, 0
    for name, _ in files_of(path):
        n = found.get(name, 0)
        files.append({"path": name, "line": line, "entry": entry, "lines": n})
        line, entry = line + n, entry - (-n // every)
    known = spark.createDataFrame([(f["path"], f["entry"]) for f in files] or [("", 0)], "path string, entry long")
    # Sums along each file, over ranges and not over lines.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("first", F.coalesce(F.sum("n_lines").over(before), F.lit(0))).join(broadcast_if_small(known), "path")
    each = max(1, parts.count())
    offsets = firsts.select("path", "start", "stop", "first", "entry").repartitionByRange(each, "path", "start").mapInArrow(_offsets(every), "entry long, offset long")
    offsets.repartitionByRange("entry").sortWithinPartitions("entry").mapInArrow(_entry_writer(folder), "first long, n long").collect()
    write_bytes(f"{folder}/files.json", json.dumps({"every": every, "lines": line, "files": files}).encode())
    return line


class Lines:
    """Lines by number through an index; files stay open, and bytes_read says what was read."""

    def __init__(self, folder: str):
        system, at = file_system(folder)
        with system.open_input_file(f"{at}/files.json") as source:
            about = json.loads(source.read())
        self.every, self.lines, self.files = about["every"], about["lines"], [f for f in about["files"] if f["lines"]]
        self._first_lines = [f["line"] for f in self.files]
        self._parts = [p for p, _ in files_of(f"{folder}/entries-*.idx")]
        self._first_entries = [int(p.rsplit("-", 1)[1][:-4]) for p in self._parts]
        self._open, self.bytes_read = {}, 0

    def _read(self, path: str, n: int, at: int) -> bytes:
        if path not in self._open:
            system, inside = file_system(path)
            self._open[path] = system.open_input_file(inside)
        raw = self._open[path].read_at(n, at)
        self.bytes_read += len(raw)
        return raw

    def get(self, i: int) -> str:
        """The i-th line without its break; an error beyond the last."""
        if not 0 <= i < self.lines:
            raise IndexError(f"line {i} of {self.lines}")
        file = self.files[bisect.bisect_right(self._first_lines, i) - 1]
        entry = file["entry"] + (i - file["line"]) // self.every
        part = bisect.bisect_right(self._first_entries, entry) - 1
        at = int.from_bytes(self._read(self._parts[part], 8, 8 * (entry - self._first_entries[part])), "little")
        skip, held = (i - file["line"]) % self.every, b""
        while True:
            raw = self._read(file["path"], BLOCK, at)
            at, held = at + len(raw), held + raw
            breaks = held.count(b"\n")
            if breaks > skip or not raw:
                return held.split(b"\n", skip + 1)[skip].decode()
            # Only what may still hold the line is kept.
            held, skip = held.rsplit(b"\n", 1)[-1], skip - breaks

    def sample(self, i: int, bucket: int) -> str:
        """The line of a replicated sample: the bucket's lines come again and again."""
        return self.get(i % bucket)


def lookup(rows: DataFrame, index: str, folder: str, name: str = "line") -> DataFrame:
    """rows with the line of each number; a task reads its lines by seek. Null numbers have a null line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(folder)
        for batch in batches:
            found = [None if i is None else lines.get(i) for i in batch.column(index).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, f"{fields}, `{name}` string")
