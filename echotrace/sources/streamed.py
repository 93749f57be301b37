"""Rank files that grow while their records are made, and go on where a run broke off.

A rank is one stream: its rows go through one task in their order, and the generator and the writer run there together. Records are
flushed line by line to a hidden part file; every so many records the part gets its name, which says where it begins and how
many records it holds. That is the first phase: a part with a name is whole and stays. When all ranks are through, the job
commits (_SUCCESS). A run that comes after a broken one asks for each rank how far its named parts go without a hole, and makes
the rest only. A task that runs twice makes the same parts, so each record is there once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from echotrace.sources.ranges import file_system, files_of
from echotrace.sources.shared import global_row_number

#: Takes rows (dicts) and returns their records (dicts), in the same order.
Make = Callable[[list[dict]], list[dict]]
_PART = re.compile(r"part-(\d+)-(\d+)\.json$")


@dataclass
class RanksDone(WriterCommitMessage):
    records: int


def committed(folder: str, world: int) -> list[int]:
    """For each rank, how many records its named parts hold from the first on without a hole."""
    out = []
    for rank in range(world):
        try:
            names = [m for path, _ in files_of(f"{folder}/rank{rank}.jsonl") if (m := _PART.search(path))]
        except FileNotFoundError:
            names = []
        n = 0
        for first, size in sorted((int(m[1]), int(m[2])) for m in names):
            n = first + size if first <= n else n
        out.append(n)
    return out


class _RankWriter(DataSourceArrowWriter):
    """Rows with _rank and _place; a task's rows are whole ranks, each in order of places."""

    def __init__(self, folder: str, every: int, batch: int, make: Make):
        self.folder, self.every, self.batch, self.make = folder, every, batch, make

    def write(self, iterator: Iterator[pa.RecordBatch]) -> RanksDone:
        system, at = file_system(self.folder)
        n, rank, first, held, out = 0, None, 0, 0, None

        def finish() -> None:
            nonlocal out, held
            if out is not None:
                out.close()
                system.move(f"{at}/rank{rank}.jsonl/.part-{first:012d}.tmp", f"{at}/rank{rank}.jsonl/part-{first:012d}-{held:06d}.json")
            out, held = None, 0

        for batch in iterator:
            rows = batch.to_pylist()
            for begin in range(0, len(rows), self.batch):
                some = rows[begin : begin + self.batch]
                places = [(r.pop("_rank"), r.pop("_place")) for r in some]
                made = self.make(some)
                if len(made) != len(some):
                    raise ValueError(f"{len(made)} records were made of {len(some)} rows")
                for (of, place), record in zip(places, made, strict=True):
                    if of != rank or held == self.every:
                        finish()
                        rank = of
                    if out is None:
                        system.create_dir(f"{at}/rank{rank}.jsonl", recursive=True)
                        first, out = place, system.open_output_stream(f"{at}/rank{rank}.jsonl/.part-{place:012d}.tmp")
                    out.write((json.dumps(record, ensure_ascii=False) + "\n").encode())
                    out.flush()
                    held, n = held + 1, n + 1
        finish()
        return RanksDone(n)

    def commit(self, messages: list[RanksDone | None]) -> None:
        system, at = file_system(self.folder)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages: list[RanksDone | None]) -> None:
        """Named parts stay for the next run."""


def stream_rank_files(
    rows: DataFrame, folder: str, order: list[Column], world: int, make: Make = lambda rows: rows, every: int = 100, batch: int = 8
) -> int:
    """Deals rows in the given order to `world` ranks, makes a record of each, `batch` at a time, and writes it to its rank at once.

    Run again after a failure, it makes only what isn't there. Returns how many records were there before. A part has at most
    `every` records; as many, at most, are made twice for each rank. Rows and their order must be the same in both runs.
    """
    spark, done = rows.sparkSession, committed(folder, world)
    numbered, _ = global_row_number(rows, order, "_at")
    dealt = numbered.withColumns({"_rank": (F.col("_at") % world).cast("int"), "_place": F.floor(F.col("_at") / world)}).drop("_at")
    ready = F.element_at(F.array(*map(F.lit, done)), F.col("_rank") + 1)  # a number for each rank
    left = dealt.where(F.col("_place") >= ready).repartitionById(world, "_rank").sortWithinPartitions("_rank", "_place")

    class RankSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "echotrace_rank_sink"

        def writer(self, schema, overwrite) -> DataSourceArrowWriter:
            return _RankWriter(folder, every, batch, make)

    spark.dataSource.register(RankSink)
    left.write.format("echotrace_rank_sink").mode("append").save()
    return sum(done)
