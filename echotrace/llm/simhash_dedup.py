"""SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints (64 bits, 8 bytes) that differ in at most RADIUS = 4 bits differ in at most 4 bytes, so a linked pair shares at
least 4 of the 8 positional bytes: the guaranteed minimum. The index has a list of fingerprints for each byte value at each
of the first five positions: of any five positions a linked pair shares one at least, so it meets in a list. The members of a list are
indexed by all their positional bytes again, each such entry gives its pairs one count, and counts are added up pair by pair;
pairs that reach the minimum are retained and verified by their Hamming distance. Fingerprints are made distinct first, so copies never make pairs.

A list holds 1/256 of all fingerprints, and pairs in it grow with its square. So from BLOCK * 256 fingerprints on, a list
stands for two positional bytes (of the first six positions a linked pair shares two), later for three or four: lists stay about
as long whatever the input, and counts, minimum and verification are the same. A list of more than BLOCK fingerprints
is cut into blocks before any of it moves, and every pair of blocks becomes a cell of its own, so no task holds more than two blocks and no
pair is lost. Where very many pairs share entries, the counts of one fingerprint with all not yet reached are made at
once instead. A cell returns a star for each of its connected groups instead of all links, which leaves reachability as it is.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of 4 words joined by a space, repeats included (fewer words:
the whole sequence; none: fingerprint 0); a bit is 1 if set in over half of the shingles' XXH64 (seed 42).

Defined results: null and empty text have fingerprint 0 and are linked like any other; null ids never become a component's id
unless it has no other; repeated rows return repeated rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm._common import broadcast_if_small, stored
from echotrace.llm.components import components

SHINGLE, SEED, RADIUS, BYTES = 4, 42, 4, 8
BLOCK = 4096
#: Least number of positional bytes that a linked pair shares.
SHARED = BYTES - RADIUS
#: Pairs whose counts are added up at once.
_PAIRS = 4_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PART = 1 << 15


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    a, b = starts[:n].tolist(), ends[SHINGLE - 1 :].tolist()
    for i in range(0, n, _PART):
        hashes = np.fromiter(
            (digest(line[s:e], SEED) for s, e in zip(a[i : i + _PART], b[i : i + _PART], strict=True)), dtype=">u8", count=min(_PART, n - i)
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def simhash_signed(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in text], dtype=np.uint64).view(np.int64))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _entry_pairs(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with the same entry."""
    order = np.argsort(entry, kind="stable")
    sorted_entry = entry[order]
    first = np.flatnonzero(np.append(True, sorted_entry[1:] != sorted_entry[:-1]))
    size = np.diff(np.append(first, len(entry)))
    begin = np.repeat(first, size)
    before = np.arange(len(entry)) - begin
    later = np.repeat(np.arange(len(entry)), before)
    earlier = np.repeat(begin, before) + np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before)
    return order[later], order[earlier]


def counted_links(fps: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each two fingerprints of one cell that share SHARED positional bytes by count and are linked."""
    parts, n = [np.zeros(0, dtype=np.int64)], len(fps)
    octets = fps.view(np.uint8).reshape(-1, BYTES).astype(np.int64)
    for position in range(BYTES):
        i, j = _entry_pairs(cell * 256 + octets[:, position])
        parts.append(np.minimum(i, j) * n + np.maximum(i, j))
    pairs, shared = np.unique(np.concatenate(parts), return_counts=True)
    i, j = np.divmod(pairs[shared >= SHARED], n)
    linked = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
    return i[linked], j[linked]


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places over the links i, j."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def crowded_stars(fps: np.ndarray) -> np.ndarray:
    """The same for one cell, counting from one fingerprint to all that aren't reached yet."""
    octets = fps.view(np.uint8).reshape(-1, BYTES)
    root, left = np.arange(len(fps)), np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        reached = [start]
        while reached and len(left):
            at = reached.pop()
            shared = (octets[left] == octets[at]).sum(axis=1)
            hit = shared >= SHARED
            hit[hit] = np.bitwise_count(fps[left[hit]] ^ fps[at]) <= RADIUS
            root[left[hit]] = start
            reached += left[hit].tolist()
            left = left[~hit]
    return root


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell (key, lo, hi); a cell may reach over batches."""
    rest = np.zeros((4, 0), dtype=np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi", "fp")])], axis=1)
        cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        rest = rows[:, last:]
        yield from _links_of(rows[3, :last], np.append(0, cuts))
    yield from _links_of(rest[3], np.array([0, rest.shape[1]]))


def _links_of(signed: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """u, v: stars of the cells between the cuts; as many cells at a time as _PAIRS allows."""
    if not len(signed):
        return
    fps, sizes = np.ascontiguousarray(signed).view(np.uint64), np.diff(cuts)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    octets, weight = fps.view(np.uint8).reshape(-1, BYTES), np.zeros(len(sizes), dtype=np.int64)
    for position in range(BYTES):
        entry, n = np.unique(cell * 256 + octets[:, position], return_counts=True)
        weight += np.bincount(entry // 256, n * (n - 1) // 2, minlength=len(sizes)).astype(np.int64)
    at = 0
    while at < len(sizes):
        a, upto = cuts[at], at + max(1, int(np.searchsorted(np.cumsum(weight[at:]), _PAIRS, "right")))
        part = fps[a : cuts[upto]]
        if weight[at] > _PAIRS:
            root = crowded_stars(part)
        else:
            root = stars(len(part), *counted_links(part, cell[a : cuts[upto]] - at))
        node = np.flatnonzero(root != np.arange(len(part)))
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(part[x].view(np.int64)) for x in (root[node], node)], ["u", "v"])
        at = upto


def positions_of(n: int, block: int = BLOCK) -> int:
    """How many positional bytes a list stands for, so that it has about `block` of n fingerprints at most."""
    return next((k for k in range(1, SHARED) if n <= block * 256**k), SHARED)


def _keys(fp: Column, positions: int) -> Column:
    """One long for each choice of so many of the first RADIUS + positions places: which choice, and its bytes."""
    byte = [F.shiftright(fp, 8 * i).bitwiseAND(255) for i in range(BYTES)]
    keys = []
    for number, choice in enumerate(combinations(range(RADIUS + positions), positions)):
        key = F.lit(number).cast("long")
        for place in choice:
            key = key * 256 + byte[place]
        keys.append(key)
    return F.array(*keys)


def link_forest(fps: DataFrame, block: int = BLOCK, positions: int | None = None) -> DataFrame:
    """u, v: enough edges to connect all of the distinct fingerprints fp (stored) that are linked (at most RADIUS bits apart)."""
    positions = positions or positions_of(fps.count(), block)
    index = fps.select("fp", F.explode(_keys(F.col("fp"), positions)).alias("key"))
    long_lists = stored(index.groupBy("key").count().where(F.col("count") > block), "long-lists")
    lists = index.join(broadcast_if_small(long_lists), "key", "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    lists = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = lists.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return cells.mapInArrow(_cell_links, "u long, v long").distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), simhash_signed(F.col(text_col).cast("string")).alias("fp"))


def fingerprint_components(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, component_id for each distinct fp of rows (doc_id, fp), which should be stored."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(link_forest(fps, block))
    tree = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = tree.groupBy("root").agg(F.min("least").alias("component_id"))
    return tree.join(ids, "root").select("fp", "component_id", "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest id reachable over links) for each row of docs."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    groups = stored(fingerprint_components(rows, block).select("fp", "component_id"), "groups")
    return rows.join(groups, "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
