"""Matches of texts against a whole corpus: the longest run of tokens that stands anywhere in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.sources.shared import broadcast_if_small, stored

_ID = ["a", "b"]
#: Runs shorter than this are looked up length by length; from here on sizes are doubled.
LONG = 6
#: Bits of a table of marks: 16 for each window, 64 MB at most. It is sent in blocks.
BITS_EACH, MOST_BITS, BLOCK = 16, 29, 18
#: Tokens that a task works on at once (a row's, if it has more).
AT_ONCE = 1 << 20
_A, _B, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def _id(*parts: Column) -> list[Column]:
    """128 bits that stand for a window: two hashes that are independent of each other."""
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b")]


def _hashed(df: DataFrame, tag: str) -> DataFrame:
    """key and t, the tokens' hashes, stored."""
    return stored(df.select("key", F.transform("tokens", lambda x: F.xxhash64(x)).alias("t")), tag)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, numbers of tokens and all tokens of some rows at a time."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            tokens = batch.column(1).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.column(0).slice(i, j - i), sizes[i:j], tokens


def _window_rows(size: int, bits: int, marks: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sizes, tokens in _slices(batch):
                n = len(tokens) - size + 1
                if n <= 0:
                    continue
                ends = np.cumsum(sizes)
                a = np.zeros(n, np.uint64)
                for i in range(size):
                    a = a * _A + tokens[i : i + n]
                good = np.arange(size, n + size) <= np.repeat(ends, sizes)[:n]  # doesn't go on in the next row
                if marks is not None:
                    bit = a >> np.uint64(64 - bits)
                    good &= (marks.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(good)
                b = np.zeros(len(at), np.uint64)
                for i in range(size):
                    t = tokens[at + i]
                    b = b * _B + (t ^ (t >> np.uint64(29))) * _MIX
                row = np.searchsorted(ends, at, "right")
                pos = (at - (ends - sizes)[row]).astype(np.int32)
                columns = [keys.take(pa.array(row)), pa.array(pos), pa.array(a[at].view(np.int64)), pa.array(b.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "a", "b"])

    return work


def _windows(rows: DataFrame, size: int, bits: int = 0, marks: Broadcast | None = None) -> DataFrame:
    """key, pos, a, b of all windows of so many tokens (rows: key, t), or of those alone whose bit is set in the table of marks."""
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_window_rows(size, bits, marks), f"key {kind}, pos int, a long, b long")


def _bit_rows(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        bit = np.unique(np.concatenate(found))
        blocks, first = np.unique(bit >> BLOCK, return_index=True)
        offsets = np.append(first, len(bit)).astype(np.int32) * 4
        inside = (bit & ((1 << BLOCK) - 1)).astype("<u4")
        each = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
        return pa.RecordBatch.from_arrays([pa.array(blocks), each], ["block", "at"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            found.append((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            n += len(found[-1])
            if n >= AT_ONCE:
                yield rows(found)
                found, n = [], 0
        if n:
            yield rows(found)

    return work


def _packed(rows: pa.Table) -> pa.Table:
    block = np.zeros(1 << BLOCK, np.uint8)
    for at in rows["at"]:
        block[np.frombuffer(at.as_buffer(), "<u4")] = 1
    return pa.table({"block": rows["block"].slice(0, 1), "packed": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})


def _marks(own: DataFrame) -> tuple[int, Broadcast]:
    """A table of 2 ** bits bits, those of the given windows set. It lets all of them pass and few others, which a join has to tell apart.

    Tasks pack blocks of it; the driver puts at most 64 MB together and sends them, whatever the number of windows.
    """
    bits = min(MOST_BITS, max(BLOCK, (own.count() * BITS_EACH).bit_length()))
    rows = own.select("a").mapInArrow(_bit_rows(bits), "block long, at binary")
    table = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK - 3)
    for block, packed in rows.groupBy("block").applyInArrow(_packed, "block long, packed binary").collect():
        table[block * width : (block + 1) * width] = np.frombuffer(packed, np.uint8)
    return bits, own.sparkSession.sparkContext.broadcast(table)


def _known(rows: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    """rows whose names occur in the other table."""
    return rows.join(broadcast_if_small(stored(ids.select(*names).distinct(), "ids")), names, "left_semi")


def _pairs(rows: DataFrame, places: DataFrame, ahead: Column) -> DataFrame:
    """rows with the window of their size that begins `ahead` places on, where it is known too: a2 and b2."""
    after = places.select("size", "key", F.col("pos").alias("_pos"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return rows.withColumn("_pos", F.col("pos") + ahead).join(after, ["size", "key", "_pos"]).drop("_pos")


def common_windows(texts: DataFrame, corpus: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """size, key, pos, a, b of the windows of `size`, twice as many, and so on tokens that texts and corpus have in common, on both sides.

    texts, corpus: key and t. A window of twice the size is two neighbours that are known on its side, so only places that
    matched go on to the next size, and sizes end with the longest match.
    """
    spark, level = texts.sparkSession, F.lit(size).alias("size")
    own = stored(_windows(texts, size).select(level, "*"), "windows")
    other = stored(_known(_windows(corpus, size, *_marks(own)).select(level, "*"), own, _ID), "windows")
    own = stored(_known(own, other, _ID), "windows")
    found = [(own, other)]
    while not own.isEmpty():
        level = (F.col("size") * 2).alias("size")
        double = lambda rows: _pairs(rows, rows, F.col("size")).select(level, "key", "pos", *_id(*map(F.col, ("a", "b", "a2", "b2"))))  # noqa: E731, B023
        more = stored(double(own), "windows")
        other = stored(_known(double(other), more, _ID), "windows")
        own = stored(_known(more, other, _ID), "windows")
        found.append((own, other))
    both = [spark.createDataFrame([], own.schema)] * 2
    for pair in found:
        both = [x.unionByName(y) for x, y in zip(both, pair, strict=True)]
    return both[0], both[1]


def _windows_of(own: DataFrame, other: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows of the wanted lengths (key, size, length; at most twice the size) in the texts, and of the same lengths and ids in the corpus.

    Such a window is two known ones that overlap. In the corpus, places are asked for by the id of the first one.
    """
    rows = own.join(broadcast_if_small(lengths), ["key", "size"])
    ids = [*_ID, "a2", "b2"]
    mine = stored(_pairs(rows, own, F.col("length") - F.col("size")).select("size", "length", "key", "pos", *ids), "wanted")
    asked = stored(mine.select("size", *_ID, "length").distinct(), "asked")
    there = other.join(broadcast_if_small(asked), ["size", *_ID])
    theirs = _pairs(there, other, F.col("length") - F.col("size")).select("size", "length", "key", "pos", *ids)
    return mine, stored(_known(theirs, mine, ["size", "length", *ids]), "there")


def _runs_of(texts: DataFrame, corpus: DataFrame, size: int) -> DataFrame:
    """key and m (length, pos, first, occurrences): the first window of so many tokens of each text that stands in the corpus.

    The corpus's places are counted by window before they meet the texts, so a frequent window is one row for each task.
    """
    own = stored(_windows(texts, size), "windows")
    first, pos = F.min(F.struct("key", "pos")).alias("first"), F.col("pos")
    places = _windows(corpus, size, *_marks(own)).groupBy(*_ID).agg(first, F.count("*").alias("occurrences"))
    hits = own.join(places, _ID)
    return hits.groupBy("key").agg(F.min_by(F.struct(F.lit(size).alias("length"), pos, "first", "occurrences"), pos).alias("m"))


def _long_runs(texts: DataFrame, corpus: DataFrame, size: int) -> DataFrame:
    """The same for the longest run of `size` tokens or more; texts without one are left out.

    Sizes are doubled as long as something matches; then the length between a text's last matching size and twice that is
    halved in on.
    """
    own, other = common_windows(texts, corpus, size)
    state = own.groupBy("key").agg(F.max("size").alias("size")).select("key", "size", F.col("size").alias("low"), (F.col("size") * 2).alias("high"))
    state = stored(state, "lengths")
    while not (wide := state.where("high - low > 1")).isEmpty():
        tried = stored(wide.select("key", "size", F.floor((F.col("low") + F.col("high")) / 2).cast("int").alias("length")), "tried")
        mine, theirs = _windows_of(own, other, tried)
        hit = stored(_known(mine, theirs, ["size", "length", *_ID, "a2", "b2"]).select("key").distinct(), "hit").withColumn("_hit", F.lit(True))
        state = state.join(tried.drop("size"), "key", "left").join(broadcast_if_small(hit), "key", "left")
        low = F.when(F.col("_hit"), F.col("length")).otherwise(F.col("low")).alias("low")
        high = F.when(F.col("length").isNotNull() & F.col("_hit").isNull(), F.col("length")).otherwise(F.col("high")).alias("high")
        state = stored(state.select("key", "size", low, high), "lengths")
    mine, theirs = _windows_of(own, other, state.select("key", "size", F.col("low").alias("length")))
    ids = ["size", "length", *_ID, "a2", "b2"]
    places = theirs.groupBy(*ids).agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("occurrences"))
    return mine.join(places, ids).groupBy("key").agg(F.min_by(F.struct("length", "pos", "first", "occurrences"), "pos").alias("m"))


def longest_in_corpus(texts: DataFrame, key: str, tokens: str, corpus: DataFrame, doc_id: str, doc_tokens: str, min_length: int = 2) -> DataFrame:
    """key, length, start1, end1, doc_id, start2, end2, occurrences: the longest run of tokens that each text shares with any document.

    Of equally long ones the first in the text counts, at its first place in the corpus by id; occurrences says at how many places of the corpus
    it stands. Texts without a run of min_length have nulls. Keys of texts are distinct and not null.

    Texts with a run of LONG tokens come first. The others are tried at each shorter length in turn, and those that have a run of it are
    done. So short windows, which stand everywhere in a large corpus, are asked for by the texts alone that have no longer ones. All places
    are rows: no table of a text against a document is made, whatever the number of documents.
    """
    named = texts.select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    docs = _hashed(corpus.select(F.col(doc_id).alias("key"), F.col(doc_tokens).alias("tokens")), "documents")
    rest = _hashed(named, "texts")
    size = max(LONG, min_length)
    parts = [stored(_long_runs(rest, docs, size), "runs")]
    for n in range(size - 1, min_length - 1, -1):
        rest = stored(rest.join(broadcast_if_small(parts[-1].select("key")), "key", "left_anti"), "rest")
        if rest.isEmpty():
            break
        parts.append(stored(_runs_of(rest, docs, n), "runs"))
    found = named.select("key").join(reduce(DataFrame.unionByName, parts), "key", "left")
    start1, start2, n = F.col("m.pos"), F.col("m.first.pos"), F.col("m.length")
    return found.select(
        F.col("key").alias(key),
        n.alias("length"),
        start1.alias("start1"),
        (start1 + n).alias("end1"),
        F.col("m.first.key").alias(doc_id),
        start2.alias("start2"),
        (start2 + n).alias("end2"),
        F.col("m.occurrences").alias("occurrences"),
    )
