"""Line dedup by content-defined chunks of lines, and passages.

Lines are runs of words between line breaks, without the white space around them; words are separated by ASCII white space.
A rolling hash over the last WINDOW line hashes marks a line where it falls into one of MODULUS classes, and a chunk ends at
a marked line that doesn't follow a marked one, so boundaries follow the lines around them, come back soon after an insertion,
and a chunk has two lines at least (but for the first and last of a text). Chunks of two or more lines that occur more than
once in all documents are repeated, however short they are.

Chunks alone miss what lies beside their boundaries: of passages of 2, 4, 8 and 12 lines between other lines they find 2, 8, 63 and 93 in
a hundred, and parts of those. So a match is carried on line by line: every two neighbouring lines are looked up like a chunk, and what
is repeated at one distance grows together, up to the last line that both places share. Of passages of two lines or more, all lines
go, wherever they stand and however short they are.

Passages inside of lines have no neighbouring lines, so windows are looked up as well: a unit is a line or a sentence of a
line, and from each unit the shortest window of at least PASSAGE words is taken to the right and to the left. Any repeated run
of units with PASSAGE words or more is a union of such windows, wherever it begins and ends, so none is missed. Windows, pairs and
chunks with the same first place and the same distance to it are merged to spans, whose bytes are compared with
the first place's; of equal ones the first, by (doc_id, text hash, position), stays and the others are removed. A span that
overlaps its own first place removes only what lies beyond that.

The hash of a span is a polynomial of its bytes modulo 2^64, from prefix sums over the whole text, so it costs the same for spans of any length;
all of it is array arithmetic on Arrow's own buffers. Texts with the same hash as another's are compared as a whole, and only the first goes
through chunks and windows. Of those, only candidates have their windows looked up: in each window to the right the pair of
neighbouring units with the smallest hash is its seed (a window of one unit is its own), so texts that share a window share
its seed, and a text none of whose seeds and chunks occurs twice has nothing to remove. Only positions and hashes are shuffled for the
counts, with counts made before the shuffle; texts of repeated spans alone are gathered for the comparison, which again is a
count made before the shuffle, so a passage in a third of all documents is one row from each task.

Defined results: null text stays null and has no lines; empty text stays empty; a row repeated as a whole keeps what its copy
keeps; null ids count as a value of their own and come first; a single line or sentence of fewer than PASSAGE words is no
chunk and stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm._common import broadcast_if_small, stored
from echotrace.llm._prefix import BASE, MIX, inverse_power, mixed, prefix_at  # noqa: F401

WINDOW, MODULUS, PASSAGE, MIN_LINES = 2, 2, 50, 2
_WHITE = " \t\n\r\f\v"
_BREAK, _STOPS = 10, (33, 46, 63)  # line break; ! . ?
#: Bytes of text worked on at a time; a longer text is worked on alone.
_SLICE = 1 << 20


class Words:
    """The words of many texts that lie one after another in raw: where they begin and end, and what begins with them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        full = offsets[:-1][np.diff(offsets) > 0]
        opens, closes = ~white, ~white
        if len(raw):
            opens[1:] &= white[:-1]
            closes[:-1] &= white[1:]
            opens[full] = ~white[full]
            last = np.append(full[1:], len(raw)) - 1
            closes[last] = ~white[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        n = len(self.start)
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        new_text = np.ones(n, dtype=bool)
        new_text[1:] = self.owner[1:] != self.owner[:-1]
        breaks = np.flatnonzero(raw == _BREAK)
        seen = np.searchsorted(breaks, self.start)
        self.opens_line, self.opens_unit = new_text.copy(), new_text.copy()
        self.opens_line[1:] |= seen[1:] > seen[:-1]
        self.opens_unit[1:] |= self.opens_line[1:] | np.isin(raw[self.end[:-1] - 1], _STOPS)
        both = np.stack([self.start, self.end], axis=1).ravel()  # ascending
        prefix = prefix_at(raw, both).reshape(-1, 2)
        self.before, self.upto = prefix[:, 0], prefix[:, 1]

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of what lies from the start of word a to the end of word b."""
        return mixed((self.upto[b] - self.before[a]) * inverse_power(self.start[a]))

    def groups(self, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each line or unit."""
        first = np.flatnonzero(opens)
        return first, np.append(first[1:], len(opens))[: len(first)] - 1

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of each chunk of MIN_LINES lines or more."""
        first, last = self.groups(self.opens_line)
        n, owner = len(first), self.owner[first]
        rolled = self.hashes(first, last)
        same = np.zeros(n, dtype=bool)  # the line before is of the same text
        same[1:] = owner[1:] == owner[:-1]
        rolled[1:] += np.where(same[1:], rolled[:-1], np.uint64(0)) * np.uint64(BASE)
        marked = mixed(rolled) % np.uint64(MODULUS) == 0
        ends = marked & same
        ends[1:] &= ~(marked[:-1] & same[1:])
        if n:
            ends[:-1] |= ~same[1:]
            ends[-1] = True
        to = np.flatnonzero(ends)
        begin = np.append(0, to[:-1] + 1)[: len(to)]
        enough = to - begin + 1 >= MIN_LINES
        return first[begin[enough]], last[to[enough]]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of every two lines that follow each other."""
        first, last = self.groups(self.opens_line)
        same = np.flatnonzero(self.owner[first[1:]] == self.owner[first[:-1]])
        return first[same], last[same + 1]

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of the shortest windows of so many words from each unit to both sides."""
        first, last = self.groups(self.opens_unit)
        n, total = len(first), np.append(first, len(self.start))
        unit = np.arange(n)
        to = np.searchsorted(total, first + words, "left") - 1
        fits = to < n
        right = np.stack([unit[fits], to[fits]])
        begin = np.searchsorted(total, last + 1 - words, "right") - 1
        # Those that are the shortest to the right as well are there already.
        fits = begin >= 0
        fits[fits] = to[begin[fits]] != unit[fits]
        left = np.stack([begin[fits], unit[fits]])
        a, b = np.concatenate([right, left], axis=1)
        inside = self.owner[first[a]] == self.owner[first[b]]
        return first[a[inside]], last[b[inside]]


    def seeds(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each unit with a window to the right, and first and last word of that window's seed: the pair of units with the smallest hash, or the one unit."""
        first, last = self.groups(self.opens_unit)
        n, total = len(first), np.append(first, len(self.start))
        to = np.searchsorted(total, first + words, "left") - 1
        a = np.flatnonzero(to < n)
        a = a[self.owner[first[a]] == self.owner[first[to[a]]]]
        b, unit, seed = to[a], a, np.stack([a, a])
        several = np.flatnonzero(a < b)
        a, b = a[several], b[several]
        if not len(a):
            return first[unit], first[seed[0]], last[seed[1]]
        # Ranks of all pairs, least ranks of runs of 1, 2, 4, .. pairs, and for each window the less of two runs that cover it.
        by_hash = np.argsort(self.hashes(first[:-1], last[1:]), kind="stable")
        rank = np.empty(n - 1, dtype=np.int64)
        rank[by_hash] = np.arange(n - 1)
        length, least = b - a, np.empty(len(a), dtype=np.int64)
        step = 1
        while True:
            of = (length >= step) & (length < 2 * step)
            least[of] = np.minimum(rank[a[of]], rank[b[of] - step])
            if 2 * step > length.max():
                break
            rank = np.minimum(rank[: len(rank) - step], rank[step:])
            step *= 2
        seed[:, several] = by_hash[least] + np.array([[0], [1]])
        return first[unit], first[seed[0]], last[seed[1]]


def words_of(texts: pa.Array) -> Words:
    """The words of an array of texts without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return Words(raw, offsets - offsets[0])


def _pairs(n: int, *spans: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of all spans, each once."""
    a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    return np.divmod(np.unique(a * (n + 1) + b), n + 1)


def seeds_of(texts: pa.Array, passage: int | None = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each chunk, pair of lines and seed."""
    words = words_of(texts)
    spans = [words.chunks(), words.neighbours()]
    if passage is not None:
        spans.append(words.seeds(passage)[1:])
    a, b = _pairs(len(words.start), *spans)
    return words.owner[a], words.hashes(a, b).view(np.int64)


def spans_of(texts: pa.Array, passage: int | None = PASSAGE, repeated: np.ndarray | None = None) -> tuple[
    np.ndarray, np.ndarray, np.ndarray, np.ndarray
]:
    """Text, start, length (in characters) and hash of each chunk, pair of lines and window of an array of texts without nulls.

    repeated: the hashes of chunks, pairs and seeds that occur elsewhere; only chunks and pairs with one, and windows that hold such a seed, are given. A window to the left
    holds the window to the right of its first unit, and so its seed.
    """
    words = words_of(texts)
    raw, offsets, n = words.raw, words.offsets, len(words.start)
    a, b = _pairs(n, words.chunks(), words.neighbours())
    if repeated is not None:
        some = np.isin(words.hashes(a, b).view(np.int64), repeated)
        a, b = a[some], b[some]
    if passage is not None:
        c, d = words.windows(passage)
        if repeated is not None:
            unit, e, f = words.seeds(passage)
            holds = np.zeros(n, dtype=bool)
            holds[unit] = np.isin(words.hashes(e, f).view(np.int64), repeated)
            c, d = c[holds[c]], d[holds[c]]
        a, b = _pairs(n, (a, b), (c, d))
    start, end, owner = words.start[a], words.end[b], words.owner[a]
    h = words.hashes(a, b).view(np.int64)
    if len(raw) and raw.max() > 127:
        place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
        start, end, offsets = place[start], place[end], place[offsets]
    return owner, start - offsets[owner], end - start, h


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, size) with about so many bytes at a time."""
    for batch in batches:
        sizes, at = np.cumsum(batch.column("size").to_numpy()), 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, before + _SLICE, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def _seed_rows(passage: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            owner, h = seeds_of(part.column("text"), passage)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner)), pa.array(h)], ["key", "hash"])

    return rows


def _span_rows(passage: int | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            owner, start, length, h = spans_of(part.column("text"), passage, pc.list_flatten(part.column("seeds")).to_numpy())
            arrays = [
                part.column("key").take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(h)
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "length", "hash"])

    return rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("text"))


def _copies(texts: DataFrame, passage: int | None) -> tuple[DataFrame, DataFrame]:
    """The texts without those whose hash another has before them, and a span of all of each of the others that is a chunk or passage."""
    same = texts.where("text is not null").groupBy(F.col("key.text_hash").alias("h")).agg(
        F.min("key").alias("first"), F.max("key").alias("last")
    )
    same = broadcast_if_small(stored(same.where("NOT (first <=> last)").select("h", "first"), "copied"))
    marked = texts.where("text is not null").join(same, F.col("key.text_hash") == F.col("h"), "left")
    later = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    white = F.lit(_WHITE)
    bare = F.trim(F.col("text"), white)
    copied = marked.where(later).select("key", "first", "text", F.when(F.col("first").isNotNull(), bare).alias("bare"))
    n_lines = F.size(F.filter(F.split("bare", "\n"), lambda x: F.trim(x, white) != ""))
    counts = n_lines >= MIN_LINES
    if passage is not None:
        counts = counts | (F.size(F.split("bare", "[ \t\n\r\f\\x0B]+")) >= passage)
    start = (F.length("text") - F.length(F.ltrim(F.col("text"), white))).alias("start")
    spans = copied.where(counts).select(
        "key", start, F.length("bare").alias("length"), start.alias("cut"), F.col("first").alias("origin"), start.alias("from")
    )
    return marked.where(~later).select("key", "text"), spans.distinct()


def repeated_spans(docs: DataFrame, passage: int | None = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (doc_id, text hash), start, length of each span that is to go; spans may overlap. passage: words of a passage, or None for chunks and pairs of lines only."""
    texts = _keyed(docs, id_col, text_col)
    fresh, whole = _copies(texts, passage)
    rows, key = fresh.select("key", "text", F.octet_length("text").cast("long").alias("size")), texts.schema["key"].dataType.simpleString()
    # Repeated hashes grow with the input, so they are never broadcast; both sides of these joins are read from
    # tables, so that a frequent hash's rows can be split over tasks.
    seeds = stored(rows.mapInArrow(_seed_rows(passage), f"key {key}, hash long"), "seeds")
    again = stored(seeds.groupBy("hash").count().where("count > 1").select("hash"), "repeated-seeds")
    held = stored(seeds.join(again.hint("merge"), "hash").groupBy("key").agg(F.collect_set("hash").alias("seeds")), "candidates")
    rows = rows.join(broadcast_if_small(held, weight=64 + 8 * F.size("seeds")), "key").select("key", "text", "size", "seeds")
    spans = stored(rows.mapInArrow(_span_rows(passage), f"key {key}, start int, length int, hash long"), "spans")
    firsts = spans.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("first")).where("n > 1")
    firsts = stored(firsts.drop("n"), "firsts")
    copies = spans.join(firsts.hint("merge"), "hash").where("NOT (key <=> first.key AND start = first.start)").drop("hash")
    # A null id is equal to itself.
    close = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("start") < F.col("first.start") + F.col("length"))
    copies = copies.select(
        "key",
        "start",
        "length",
        "first",
        F.when(close, F.col("first.start") + F.col("length")).otherwise(F.col("start")).alias("cut"),
        close.alias("close"),
    )
    # Islands of overlapping spans at one distance from the first place; a document's own rows only.
    at = Window.partitionBy(
        "key", "first.key", F.col("start") - F.col("first.start"), "close"
    ).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(
        "key", "first.key", F.col("start") - F.col("first.start"), "close"
    ).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, 0)
    marked = copies.withColumn(
        "new",
        F.when(F.col("close") | (F.col("start") > F.coalesce(F.max(F.col("start") + F.col("length")).over(at), F.lit(-1))), 1).otherwise(0),
    )
    marked = marked.withColumn("island", F.sum("new").over(upto)).withColumn("origin", F.col("first.key")).withColumn(
        "distance", F.col("start") - F.col("first.start")
    )
    merged = marked.groupBy("key", "origin", "distance", "close", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), F.min("cut").alias("cut")
    )
    merged = merged.select(
        "key", "start", (F.col("end") - F.col("start")).alias("length"), "cut", "origin", (F.col("start") - F.col("distance")).alias("from")
    )
    merged = stored(merged.union(whole), "merged")
    # Bytes: the text of copies and of the first places only.
    both = merged.select("key", "start", "length", "origin", "from").union(
        merged.select(F.col("origin").alias("key"), F.col("from").alias("start"), "length", "origin", "from").distinct()
    )
    per_text = stored(both.groupBy("key").agg(F.collect_set(F.struct("start", "length", "origin", "from")).alias("all")), "wanted")
    # The bodies are cut before rows are made of them, so that no text is copied once for each.
    bodies = F.transform(
        "all",
        lambda c: F.struct(
            *(c[x] for x in ("start", "length", "origin", "from")), F.substring(F.col("text"), c["start"] + 1, c["length"]).alias("body")
        ),
    )
    pieces = texts.join(broadcast_if_small(per_text, weight=64 + 48 * F.size("all")), "key").select("key", F.explode(bodies).alias("c"))
    pieces = pieces.select("key", "c.*")
    same = ["origin", "from", "length"]
    stays = pieces.groupBy(*same, "body").agg(F.min(F.struct("key", "start")).alias("first")).select(*same, "first.*")
    gone = merged.join(stays, ["key", "start", *same], "left_anti")
    return gone.select(
        "key", F.col("cut").alias("start"), (F.col("start") + F.col("length") - F.col("cut")).cast("int").alias("length")
    ).distinct()


@F.pandas_udf(
    T.StructType([T.StructField("text", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("chunks", "lines", "chars"))])
)
def _cut_out(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """The text without the spans, and how many spans (after merging), lines or parts of lines, and characters are gone."""
    out = []
    for t, cut in zip(text, spans, strict=True):
        if t is None or cut is None:
            out.append((t, 0, 0, 0))
            continue
        merged: list[list[int]] = []
        for s, n in sorted((x["start"], x["length"]) for x in cut):
            e = s + n
            # White space after the span goes with it, but for the next line's indentation; before it, its own line's.
            after = e
            while after < len(t) and t[after] in _WHITE:
                after += 1
            e = t.rfind("\n", e, after) + 1 or after
            begin = s
            while begin and t[begin - 1] in " \t":
                begin -= 1
            if begin == 0 or t[begin - 1] == "\n":
                s = begin
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        at, kept, lines = 0, [], 0
        for s, e in merged:
            kept.append(t[at:s])
            lines += t.count("\n", s, e) + (t[e - 1] != "\n")
            at = e
        out.append(("".join([*kept, t[at:]]), len(merged), lines, sum(e - s for s, e in merged)))
    return pd.DataFrame(out, columns=["text", "chunks", "lines", "chars"])


def line_dedup(docs: DataFrame, passage: int | None = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (without repeated chunks and passages), n_chars (of that text), removed_chunks, removed_lines, removed_chars for each row of docs."""
    cut = stored(
        repeated_spans(docs, passage, id_col, text_col).groupBy("key").agg(F.collect_list(F.struct("start", "length")).alias("spans")),
        "cut",
    )
    rows = _keyed(docs, id_col, text_col).join(broadcast_if_small(cut, weight=96 + 24 * F.size("spans")), "key", "left")
    # Most texts stay as they are and don't cross to Python.
    touched = F.col("spans").isNotNull()
    changed = rows.where(touched).withColumn("c", _cut_out("text", "spans"))
    removed = [F.col(f"c.{x}").alias(f"removed_{x}") for x in ("chunks", "lines", "chars")]
    changed = changed.select(F.col("key.doc_id").alias("doc_id"), F.col("c.text").alias("text"), *removed)
    nothing = [F.lit(0).cast("long").alias(f"removed_{x}") for x in ("chunks", "lines", "chars")]
    out = changed.union(rows.where(~touched).select(F.col("key.doc_id").alias("doc_id"), "text", *nothing))
    n_chars: Column = F.length("text").cast("long").alias("n_chars")
    return out.select("doc_id", "text", n_chars, "removed_chunks", "removed_lines", "removed_chars")
