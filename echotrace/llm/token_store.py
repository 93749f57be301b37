"""Token-id shards with a minimal perfect hash index.

A store is a folder:
- shard-NNNNNNNN.ids: the ids of whole documents one after another, ascending by doc_id over shards and inside each, as
  little-endian unsigned 16-bit numbers (32-bit if the vocabulary has more than 65,536 ids); nothing else. A shard is
  closed after the document with which it reaches SHARD_BYTES.
- index-NNNNN.mph: for the keys of one hash bucket (BUCKET_KEYS on average), a minimal perfect hash function and at its
  values the entries: a stored fingerprint of the key (32 bits), shard, offset in the shard (ids), number of ids, and the
  number of ids of all documents before it in the store. In the file: a head of fixed size, the bit arrays of all levels as
  64-bit words, a rank sample (set bits before it) for each word, and the entries.
- meta.json: versions and sizes.

The hash function is a cascade of bit arrays: in each level a key hashes to one of GAMMA * n cells; keys alone in their cell
set the bit, the others go on to the next level. The value of a key is the number of set bits before its own: the word's
rank sample and the bits of that word. So `Store.get` reads the head, one word in each of a few levels, one sample, one
entry and the ids, by seek: the bytes read don't depend on the number of documents, and a key that isn't
there is found out but for one in 2^32. `lookup` answers many keys at once, a bucket at a time.

Range partitions of the documents are written as shards by one task each, file by file, so no task holds more than a part of
a file; only one row for each partition comes to the driver. Files are written under a temporary name and then renamed, so a task
that runs twice leaves the same files. Keys are (doc_id, number among the rows of that id), so repeated ids are all kept.

Defined results: null text counts as empty and holds the end id only; null ids come first, and stand beside ids of any size, as
ids cross to Python as Arrow values; strings of special tokens become their ids; repeated rows are kept each; an empty table makes an
empty store; other columns are ignored. Reading back fails if a key isn't found.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm._common import broadcast_if_small, stored
from echotrace.llm._tokens import encoder, slices

END, BUCKET_KEYS, GAMMA = 2, 20_000, 1.5
SHARD_BYTES = 64 << 20
#: Shard numbers of a partition: its number times this, and on. Numbers have 32 bits: 65,536 partitions of 4 TB.
_FILES = 1 << 16
#: Numbers of one id that are made from one row at a time.
_NUMBERS = 1 << 16
_ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u4"), ("start", "<u8")])
_MAGIC, _LEVELS = b"ETMPH2\0\0", 64
#: Magic, number of levels, number of keys, words of each level.
_HEAD = f"<8sII{_LEVELS}I"
_HEAD_SIZE = struct.calcsize(_HEAD)


def file_system(path: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class _Writer:
    """A file that gets its name when it is whole."""

    def __init__(self, path: str):
        self.system, self.path = file_system(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.out, self.size = self.system.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def finish(self) -> None:
        self.out.close()
        self.system.move(self.temporary, self.path)


def write_file(path: str, parts: list[bytes]) -> None:
    file = _Writer(path)
    for part in parts:
        file.write(part)
    file.finish()


def read_file(path: str) -> bytes:
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return f.read()


def shard_path(path: str, shard: int) -> str:
    return f"{path}/shard-{shard:08d}.ids"


def index_path(path: str, bucket: int) -> str:
    return f"{path}/index-{bucket:05d}.mph"


def _cells(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = k1 ^ (k2 * np.uint64(2 * level + 1)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def _below(word: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Set bits of a word before a bit."""
    return np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function of distinct keys, each two unsigned 64-bit numbers."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.base = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray) -> PerfectHash:
        sizes, levels = [], [np.zeros(0, dtype="<u8")]
        while len(k1):
            if len(sizes) == _LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(k1)) + 63 & ~63)
            at = _cells(k1, k2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size // 64)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            k1, k2 = k1[left], k2[left]
        words = np.concatenate(levels)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(sizes, words, (np.cumsum(ones) - ones).astype("<u4"))

    def values(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """0..n-1 for the n keys; -1 or any value for other keys."""
        out = np.full(len(k1), -1, dtype=np.int64)
        todo = np.arange(len(k1))
        for level, size in enumerate(self.sizes):
            at = _cells(k1[todo], k2[todo], level, 64 * size)
            bit, place = (at & 63).astype(np.uint64), self.base[level] + (at >> 6)
            word = self.words[place]
            hit = (word >> bit) & np.uint64(1) == 1
            out[todo[hit]] = self.ranks[place[hit]] + _below(word[hit], bit[hit])
            todo = todo[~hit]
        return out

    def to_bytes(self, keys: int) -> list[bytes]:
        head = struct.pack(_HEAD, _MAGIC, len(self.sizes), keys, *self.sizes, *[0] * (_LEVELS - len(self.sizes)))
        return [head, self.words.tobytes(), self.ranks.tobytes()]

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The function, and where the entries begin."""
        sizes = _sizes(raw)
        n = sum(sizes)
        words = np.frombuffer(raw, dtype="<u8", count=n, offset=_HEAD_SIZE)
        ranks = np.frombuffer(raw, dtype="<u4", count=n, offset=_HEAD_SIZE + 8 * n)
        return cls(sizes, words, ranks), _HEAD_SIZE + 12 * n


def _sizes(head: bytes) -> list[int]:
    magic, n, _, *sizes = struct.unpack_from(_HEAD, head)
    if magic != _MAGIC:
        raise ValueError("not an index file")
    return sizes[:n]


def _marks(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return ((k1 ^ (k2 * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)


def _keyed(rows: DataFrame, buckets: int) -> DataFrame:
    """k1, k2 and bucket of (doc_id, number)."""
    rows = rows.withColumn("number", F.col("number").cast("long"))
    rows = rows.withColumn("k1", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "number")).withColumn(
        "k2", F.xxhash64(F.lit(1), "number", "doc_id")
    )
    return rows.withColumn("bucket", F.pmod(F.xxhash64("k1"), F.lit(buckets)))


def key_of(doc_id: int | None, number: int, buckets: int) -> tuple[int, int, int]:
    """The same for one key: each value is hashed with the hash before it as its seed, and nulls are passed over."""

    def chain(*values: bytes | None) -> int:
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v, h)
        return h

    i, n = None if doc_id is None else struct.pack("<q", doc_id), struct.pack("<q", number)
    k1, k2 = chain(struct.pack("<i", doc_id is None), i, n), chain(struct.pack("<i", 1), n, i)
    (signed,) = struct.unpack("<q", struct.pack("<Q", chain(struct.pack("<Q", k1))))
    return k1, k2, signed % buckets


class _Shards:
    """The shard files of one partition."""

    def __init__(self, path: str, partition: int, kind: str, size: int):
        self.path, self.partition, self.kind, self.size = path, partition, kind, size
        self.files, self.file = 0, None

    def add(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Writes whole documents; the shard and offset of each."""
        data, width = ids.astype(self.kind), np.dtype(self.kind).itemsize
        ends = np.cumsum(counts)
        shards, offsets, done = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64), 0
        while done < len(counts):
            if self.file is None:
                self.number = self.partition * _FILES + self.files
                self.file, self.files = _Writer(shard_path(self.path, self.number)), self.files + 1
                if self.files > _FILES:
                    raise ValueError("a partition has too many shards")
            begin = int(ends[done - 1]) if done else 0
            upto = min(len(counts), done + 1 + int(np.searchsorted(ends[done:] - begin, (self.size - self.file.size) / width)))
            shards[done:upto] = self.number
            offsets[done:upto] = self.file.size // width + ends[done:upto] - counts[done:upto] - begin
            self.file.write(data[begin : int(ends[upto - 1])].tobytes())
            done = upto
            if self.file.size >= self.size:
                self.finish()
        return shards, offsets

    def finish(self) -> None:
        if self.file is not None:
            self.file.finish()
            self.file = None


def _shard_writer(path: str, tokenizer: str, keeps_space: bool, end: int, size: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, partition, row, at = encoder(tokenizer, keeps_space), TaskContext.get().partitionId(), 0, 0
        shards = _Shards(path, partition, _kind(enc.width, end), size)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, counts = enc.encode(batch.column("text").slice(a, b - a), end)
                shard, offset = shards.add(ids, counts)
                begin = at + np.cumsum(counts) - counts
                numbers = (np.full(b - a, partition), row + np.arange(b - a), shard, offset, counts, begin)
                arrays = [batch.column("doc_id").slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "row", "shard", "offset", "n", "begin"])
                row, at = row + b - a, at + len(ids)
        shards.finish()

    return write


def _kind(width: int, end: int) -> str:
    return "<u2" if max(width, end + 1) <= 65536 else "<u4"


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _index_writer(path: str):
    def write(rows: pa.Table) -> pa.Table:
        k1, k2 = (_numbers(rows, k).view(np.uint64) for k in ("k1", "k2"))
        table = PerfectHash.build(k1, k2)
        entries = np.zeros(len(k1), dtype=_ENTRY)
        at = table.values(k1, k2)
        for name in ("shard", "offset", "n", "start"):
            entries[name][at] = _numbers(rows, name)
        entries["mark"][at] = _marks(k1, k2)
        bucket = int(_numbers(rows, "bucket")[0])
        write_file(index_path(path, bucket), [*table.to_bytes(len(k1)), entries.tobytes()])
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "keys": pa.array([len(k1)], pa.int64())})

    return write


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    keeps_space: bool,
    end: int = END,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> dict:
    """Encodes docs into a new store at path, a folder that driver and executors share; returns its meta data."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", "tie", "place"]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ranged.mapInArrow(
        _shard_writer(path, tokenizer, keeps_space, end, shard_bytes),
        "doc_id long, part long, row long, shard long, offset long, n long, begin long",
    )
    written = stored(written, "written")
    parts = sorted(tuple(r) for r in written.groupBy("part").agg(F.count("*"), F.sum("n")).collect())  # a row for each partition
    bases, total_rows, total_ids = [], 0, 0
    for part, n_rows, n_ids in parts:
        bases.append((part, total_rows, total_ids))
        total_rows, total_ids = total_rows + n_rows, total_ids + n_ids
    buckets = max(1, -(-total_rows // BUCKET_KEYS))
    if bases:
        base = F.broadcast(spark.createDataFrame(bases, "part long, rows_before long, ids_before long"))  # a row for each partition
        placed = written.join(base, "part").select(
            "doc_id",
            "shard",
            "offset",
            "n",
            (F.col("row") + F.col("rows_before")).alias("row"),
            (F.col("begin") + F.col("ids_before")).alias("start"),
        )
        repeated = placed.groupBy("doc_id").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1")
        repeated = broadcast_if_small(stored(repeated.select(F.col("doc_id").alias("again"), "first"), "repeated-ids"))
        number = F.coalesce(F.col("row") - F.col("first"), F.lit(0)).alias("number")
        numbered = placed.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left").select(
            "doc_id", "shard", "offset", "n", "start", number
        )
        keyed = _keyed(numbered, buckets).select("bucket", "k1", "k2", "shard", "offset", "n", "start")
        index = keyed.groupBy("bucket").applyInArrow(_index_writer(path), "bucket long, keys long")
        written_keys = index.agg(F.sum("keys")).first()[0]
        if written_keys != total_rows:
            raise RuntimeError(f"the index has {written_keys} of {total_rows} keys")
    width = np.dtype(_kind(encoder(tokenizer, keeps_space).width, end)).itemsize
    meta = {"version": 2, "documents": total_rows, "ids": total_ids, "buckets": buckets, "end": end, "width": width}
    write_file(f"{path}/meta.json", [json.dumps(meta).encode()])
    return meta


class Store:
    """Keyed access to single documents, from any process that reaches the folder."""

    def __init__(self, path: str):
        self.path, self.meta = path, json.loads(read_file(f"{path}/meta.json"))

    def entry(self, doc_id: int | None, number: int = 0) -> dict | None:
        """shard, offset, n and start of a document, or None; reads one head, a word in each level up to its own, a sample and an entry."""
        if not self.meta["documents"]:
            return None
        k1, k2, bucket = key_of(doc_id, number, self.meta["buckets"])
        system, at = file_system(index_path(self.path, bucket))
        if system.get_file_info(at).size is None:  # no key has this bucket
            return None
        a, b = np.array([k1], dtype=np.uint64), np.array([k2], dtype=np.uint64)
        with system.open_input_file(at) as f:
            sizes = _sizes(f.read(_HEAD_SIZE))
            words, before = sum(sizes), 0
            for level, size in enumerate(sizes):
                cell = int(_cells(a, b, level, 64 * size)[0])
                place, bit = before + (cell >> 6), np.array([cell & 63], dtype=np.uint64)
                f.seek(_HEAD_SIZE + 8 * place)
                word = np.frombuffer(f.read(8), dtype="<u8")
                before += size
                if word[0] >> bit[0] & np.uint64(1):
                    break
            else:
                return None
            f.seek(_HEAD_SIZE + 8 * words + 4 * place)
            value = struct.unpack("<I", f.read(4))[0] + int(_below(word, bit)[0])
            f.seek(_HEAD_SIZE + 12 * words + _ENTRY.itemsize * value)
            found = np.frombuffer(f.read(_ENTRY.itemsize), dtype=_ENTRY)[0]
        if found["mark"] != _marks(a, b)[0]:
            return None
        return {name: int(found[name]) for name in ("shard", "offset", "n", "start")}

    def get(self, doc_id: int | None, number: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if the store doesn't have it."""
        entry = self.entry(doc_id, number)
        if entry is None:
            return None
        width = self.meta["width"]
        system, at = file_system(shard_path(self.path, entry["shard"]))
        with system.open_input_file(at) as f:
            f.seek(entry["offset"] * width)
            return np.frombuffer(f.read(entry["n"] * width), dtype=f"<u{width}")


def _lookup(path: str, strict: bool):
    def look(keys: pa.Table) -> pa.Table:
        k1, k2 = (_numbers(keys, k).view(np.uint64) for k in ("k1", "k2"))
        file = index_path(path, int(_numbers(keys, "bucket")[0]))
        system, at = file_system(file)
        value, entries = np.full(len(k1), -1), np.zeros(1, dtype=_ENTRY)
        if system.get_file_info(at).size is not None:
            raw = read_file(file)
            table, begin = PerfectHash.from_bytes(raw)
            value, entries = table.values(k1, k2), np.frombuffer(raw, dtype=_ENTRY, offset=begin)
        hit = value >= 0
        hit[hit] = entries["mark"][value[hit]] == _marks(k1[hit], k2[hit])
        if strict and not hit.all():
            raise KeyError(f"{int((~hit).sum())} keys aren't in {file}")
        found = entries[np.where(hit, value, 0)]
        numbers = {name: pa.array(np.where(hit, found[name].astype(np.int64), -1)) for name in ("shard", "offset", "n", "start")}
        return pa.table({"doc_id": keys.column("doc_id"), "number": keys.column("number"), **numbers})

    return look


def lookup(keys: DataFrame, path: str, strict: bool = False) -> DataFrame:
    """doc_id, number, shard, offset, n and start of each key (doc_id, number); -1 where the store doesn't have it, or an error if strict."""
    meta = json.loads(read_file(f"{path}/meta.json"))
    keyed = _keyed(keys.select(F.col("doc_id").cast("long").alias("doc_id"), "number"), meta["buckets"])
    return keyed.groupBy("bucket").applyInArrow(
        _lookup(path, strict), "doc_id long, number long, shard long, offset long, n long, start long"
    )


def _payload_reader(path: str, width: int, with_ids: bool):
    def read(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        file = shard_path(path, int(_numbers(rows, "shard")[0]))
        system, at = file_system(file)
        crcs, payload = [], []
        with system.open_input_file(at) as f:
            for offset, n in zip(_numbers(rows, "offset").tolist(), _numbers(rows, "n").tolist(), strict=True):
                f.seek(offset * width)
                ids = np.frombuffer(f.read(n * width), dtype=f"<u{width}").astype("<u4")
                if len(ids) != n:
                    raise RuntimeError(f"{file} ends early")
                crcs.append(zlib.crc32(ids.tobytes()))
                payload.append(ids.tolist() if with_ids else None)
        out = {
            "doc_id": rows.column("doc_id"),
            "start": rows.column("start"),
            "n_tokens": rows.column("n"),
            "ids_crc32": pa.array(crcs, pa.int64()),
        }
        return pa.table(out | ({"ids": pa.array(payload, pa.list_(pa.int32()))} if with_ids else {}))

    return read


def read_documents(keys: DataFrame, path: str, with_ids: bool = False, strict: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (with_ids: ids) of each key (doc_id, number), by the index and from the shards; keys that aren't there are left out, or an error if strict."""
    meta = json.loads(read_file(f"{path}/meta.json"))
    found = lookup(keys, path, strict).where("shard >= 0")
    return found.groupBy("shard").applyInArrow(
        _payload_reader(path, meta["width"], with_ids),
        "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids,
    )


def all_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The keys (doc_id, number) of all rows of docs."""
    counts = docs.select(F.col(id_col).cast("long").alias("doc_id")).groupBy("doc_id").count()
    # An id may stand on very many rows, so no array holds all its numbers.
    zero, last = F.lit(0).cast("long"), F.col("count") - 1
    blocks = counts.withColumn("block", F.explode(F.sequence(zero, F.floor(last / _NUMBERS))))
    upto = F.least(last, F.col("block") * _NUMBERS + (_NUMBERS - 1))
    return blocks.select("doc_id", F.explode(F.sequence(F.col("block") * _NUMBERS, upto)).alias("number"))


def store_digest(
    spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, keeps_space: bool, end: int = END, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Writes docs to a store and reads every document back from it by its key."""
    write_store(docs, path, tokenizer, keeps_space, end, shard_bytes)
    return read_documents(all_keys(docs), path, strict=True)
