"""Packing along a space-filling curve.

Each whole text becomes a hashed byte-trigram vector, projected to DIMENSIONS axes by fixed pseudo-random signs; the
position of the quantised point on a Hilbert curve is the document's key. Documents are range-sorted by (key, tie),
so a range of the curve is a partition and neighbours on the curve share sequences. Each partition is encoded and cut
into sequences of LENGTH ids as one stream: all but its last sequence are full, so less than one sequence
for each partition is padding.
The ranges hold about equal bytes: their borders are quantiles of a sample (a hash of the row chooses it) that grows with the ranges, which decides
where one stream ends and the next begins and nothing else. Keys and ids are made once, ids after the sort; only texts and keys are
shuffled. The tie is a hash of the id and the row, which spreads documents with one key, such as copies of one text, over partitions.

Defined results: null text counts as empty and is one piece with the end id only; null ids are kept beside ids of any size, as
they cross to Python as Arrow values; strings of special tokens become their ids; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm._common import stored
from echotrace.llm._text_vectors import WIDTH, unit_vector
from echotrace.llm._tokens import encoder, slices

LENGTH, END, DIMENSIONS, BITS = 1024, 0, 4, 15
#: Documents that the borders of ranges are taken from, at least and for each range; bytes of text in a range: RANGE_BYTES until there are MANY ranges, then up to MOST_BYTES.
SAMPLE, PER_RANGE, RANGE_BYTES, MANY, MOST_BYTES = 20_000, 20, 8 << 20, 4096, 128 << 20


def projection(dimensions: int = DIMENSIONS, width: int = WIDTH) -> np.ndarray:
    """Signs +1 and -1 from a multiplicative hash of the cell's number."""
    x = np.arange(width * dimensions, dtype=np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (1 - 2 * (x >> np.uint64(63)).astype(np.float32)).reshape(width, dimensions)


def quantised(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates (of about unit spread around 0) to 0..2^bits-1."""
    share = 0.5 + np.arctan(points) / np.pi
    return np.clip((share * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (n rows, d coordinates of `bits` bits).

    The orientation of the curve in the current cube is kept as the entry corner and the direction in which it is left;
    each level reads one bit of every coordinate, turned into that orientation, as a Gray code.
    """
    n, d = cells.shape
    full = (1 << d) - 1
    entry, direction, key = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rotate = lambda x, by: ((x >> by) | (x << (d - by))) & full
    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, dtype=np.int64)
        for axis in range(d):
            corner |= ((cells[:, axis] >> level) & 1) << axis
        seen = rotate(corner ^ entry, (direction + 1) % d)
        rank = seen.copy()
        for shift in (1, 2, 4, 8):
            rank ^= rank >> shift
        key = (key << d) | rank
        # Entry corner and direction of the sub-cube with this rank.
        even = np.where(rank > 0, 2 * ((rank - 1) // 2), 0)
        gray = even ^ (even >> 1)
        entry ^= rotate(gray, (d - direction - 1) % d)
        low = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(n, dtype=np.int64)
        going = rank > 0
        for i in range(d):
            going = going & (((low >> i) & 1) == 1)
            ones += going
        direction = (direction + np.where(rank == 0, 0, ones) + 1) % d
    return key


def curve_keys(texts: list[str | None], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each text."""
    signs = projection(dimensions)
    points = np.array([unit_vector(t) @ signs for t in texts]).reshape(-1, dimensions)
    return hilbert_key(quantised(points, bits), bits)


@F.pandas_udf(T.LongType())
def _key(texts: pd.Series) -> pd.Series:
    return pd.Series(curve_keys(texts.tolist()))


def range_of(keys: np.ndarray, ties: np.ndarray, border_keys: np.ndarray, border_ties: np.ndarray) -> np.ndarray:
    """How many of the sorted borders (key, tie) are at or before each row."""
    out, upto = np.searchsorted(border_keys, keys, "left"), np.searchsorted(border_keys, keys, "right")
    for i in np.flatnonzero(upto > out):  # rows with a border's key
        out[i] += np.searchsorted(border_ties[out[i] : upto[i]], ties[i], "right")
    return out


def borders(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ties at which ranges of about equal bytes begin, but for the first. rows: doc_id, text, tie.

    PER_RANGE documents for each range are drawn, `sample` at least, so ranges grow no larger with the input. The drawn rows are
    sorted by range and their bytes added up, part by part; only borders and a sum for each part come to the driver.
    """
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("text") + F.lit(1.0))).first()
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ranges = int(max(1, min(total // RANGE_BYTES + 1, MANY), total // MOST_BYTES))
    share = min(1.0, max(sample, PER_RANGE * ranges) / n)
    grid = 1 << 40
    chosen = rows if share == 1 else rows.where(F.pmod(F.xxhash64("tie"), F.lit(grid)) < int(grid * share))
    keyed = chosen.select(_key("text").alias("key"), "tie", (F.octet_length("text") + F.lit(1.0)).alias("size"))
    ranged = keyed.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sample")
    parts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("size")).collect())  # a row for each partition
    firsts, drawn = [], 0.0
    for part, size in parts:
        firsts.append((part, drawn))
        drawn += size
    first = rows.sparkSession.createDataFrame(firsts, "part int, first double")
    upto = F.sum("size").over(Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(F.broadcast(first), "part").withColumn("upto", F.col("first") + F.col("upto"))
    # A border is the row with which the sum reaches the next multiple of an equal share.
    step = drawn / ranges
    multiple = lambda x: F.least(F.floor(x / step), F.lit(ranges - 1))
    before = F.col("upto") - F.col("size")
    found = placed.where((multiple(F.col("upto")) > multiple(before)) & (before > 0)).select("key", "tie").toPandas()  # at most a row for each range
    found = found.sort_values(["key", "tie"], ignore_index=True)
    return found["key"].to_numpy(dtype=np.int64), found["tie"].to_numpy(dtype=np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(tokenizer: str, keeps_space: bool, length: int, end: int, with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, first: int, at: int) -> pa.RecordBatch:
        """Pieces of documents whose ids fill the partition's stream from place `at` on."""
        edges = at + np.concatenate(([0], np.cumsum(counts)))
        borders = np.arange(at // length + 1, (edges[-1] - 1) // length + 1) * length
        cuts = np.union1d(edges, borders)
        begin, n = cuts[:-1], np.diff(cuts)
        owner = np.searchsorted(edges, begin, "right") - 1
        raw = memoryview(ids.astype("<u4")).cast("B")
        spans = list(zip((4 * (begin - at)).tolist(), (4 * (begin - at + n)).tolist(), strict=True))
        crcs = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), dtype=np.int64, count=len(spans))
        columns = [doc_ids.take(pa.array(owner)), begin - edges[owner], n, crcs, counts[owner], first + begin // length, begin % length]
        arrays = [x if isinstance(x, pa.Array) else pa.array(x.astype(np.int64)) for x in columns]
        if with_ids:
            starts = np.append(begin, cuts[-1]) - at
            arrays.append(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(arrays, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space).encode
        first, at = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, counts = encode(batch.column("text").slice(a, b - a), end)
                yield cut(batch.column("doc_id").slice(a, b - a), ids, counts, first, at)
                at += len(ids)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    keeps_space: bool = True,
    length: int = LENGTH,
    end: int = END,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids; with_ids: the ids of each piece too (array<int>)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", F.monotonically_increasing_id()))
    border_keys, border_ties = borders(rows)

    def place(texts: pd.Series, ties: pd.Series) -> pd.DataFrame:
        keys = curve_keys(texts.tolist())
        return pd.DataFrame({"key": keys, "range": range_of(keys, ties.to_numpy(), border_keys, border_ties).astype(np.int32)})

    placed = rows.withColumn("at", F.pandas_udf(place, "key long, range int")("text", "tie")).select("doc_id", "text", "tie", "at.*")
    ranged = placed.repartitionById(len(border_keys) + 1, "range").sortWithinPartitions("key", "tie", "doc_id").select("doc_id", "text")
    return ranged.mapInArrow(_packer(tokenizer, keeps_space, length, end, with_ids), PIECES + ", ids array<int>" * with_ids)
