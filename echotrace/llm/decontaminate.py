"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE = 5 words (an item of fewer words is one shingle, and
texts are searched for shingles of that size too). For an item of W words a window is W words of a document (the
whole document if it is shorter). Steps:
1. Sieve: documents that hold no shingle of any item can't be similar to one and are left out. Each shingle of a document is looked
   up in the items' shingles, which are broadcast if few and shuffled otherwise. Nothing but keys of documents leaves this step.
2. Windows: a hit is a place p of a document where a shingle of the item stands. A window that begins elsewhere can be moved on to its first
   hit (or to the document's end) and loses none; one whose first hit follows another hit can be moved back by one and wins that one
   for at most one at its end, unless the shingle won stands in the window already. So a best window begins at a hit p
   whose place before is no hit, or whose shingle before stands again within the window's size; with the latter, texts of few
   words that repeat are whole as well. These windows are looked at, which are a few for each copy of an item, and no other
   window is more similar.
3. Multi-index Hamming blocks: windows and items have 64-bit SimHash fingerprints over shingles weighted by their counts,
   cut into BLOCKS bytes. Fingerprints at most RADIUS bits apart are at most RADIUS div BLOCKS apart in some block;
   items are indexed under all such values of each block, and a window looks up its own blocks among the entries of the items that
   put it there, so it finds every one of them within the radius and no other.
4. Verification: weighted Jaccard similarity of the exact shingles (sum of the smaller counts over sum of the larger), kept from
   SIMILARITY = 0.8 on.

RADIUS is 23, the largest for which two bits of a block are enough. Measured on 3000 random pairs of each size with the smallest
similarity from 0.8 on that the size allows (bits apart: mean, deviation, most; share of pairs beyond 20 and 23 bits):

    words   similarity   mean   deviation   most   beyond 20   beyond 23
       9       1.00       0.0      0.0        0       0           0
      13       0.80       8.7      2.8       19       0           0
      20       0.88       6.3      2.4       17       0           0
      30       0.86       7.5      2.6       18       0           0
      50       0.80       9.3      2.8       23      0.0003       0
     100       0.81       9.1      2.8       19       0           0
     200       0.81       9.5      2.9       21      0.0003       0

Only slices of a document's shingles and words are joined with anything, and cut from its row once for all of its windows.

Defined results: null or empty texts and items match nothing; null ids of documents match as a value of their own; repeated items with one
id count once for each text; repeated rows of documents give one result; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm._common import broadcast_if_small, stored, text_or_empty

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Hashes of item shingles (one long each) that are broadcast at most.
HASHES = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _shingle_starts(n: Column, k: int) -> Column:
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(tokens: Column, k: int) -> Column:
    """A hash of the hashes of each k words in a row."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.element_at(
        F.transform(
            F.array(hashed),
            lambda h: F.transform(_shingle_starts(F.size(h), k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))),
        ),
        1,
    )


def shingle_texts(tokens: Column, k: int) -> Column:
    return F.transform(_shingle_starts(F.size(tokens), k), lambda i: F.array_join(F.slice(tokens, i + 1, k), " "))


def simhash(hashes: Column) -> Column:
    """Bit by bit the majority of the hashes. Counters of two bits at a time share a long, 32 bits each."""
    pair = (1 << 32) | 1
    counts = [F.aggregate(hashes, F.lit(0).cast("long"), _adder(k, pair)) for k in range(32)]
    n, bits = F.size(hashes), []
    for k, both in enumerate(counts):
        bits.append(F.when(2 * both.bitwiseAND(0xFFFFFFFF) > n, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        high = 1 << (k + 32) if k < 31 else -(1 << 63)
        bits.append(F.when(2 * F.shiftrightunsigned(both, 32) > n, F.lit(high)).otherwise(F.lit(0)).cast("long"))
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _adder(k: int, pair: int):
    return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(pair)


def _block(fp: Column, k: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, k * bits).bitwiseAND((1 << bits) - 1)


def hamming_index(items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """item, item_fp, block and each value that a block of a fingerprint at most radius bits away may have. items: item, item_fp."""
    bits = 64 // blocks
    near = F.filter(
        F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long")),
        lambda v: F.bit_count(v.bitwiseXOR(F.col("own"))) <= radius // blocks,
    )
    index = items.select(
        "item", "item_fp", F.posexplode(F.array(*(_block(F.col("item_fp"), k, bits) for k in range(blocks)))).alias("block", "own")
    )
    return index.select("item", "item_fp", "block", F.explode(near).alias("value"))


def within_radius(windows: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows of windows (.., item, fp) whose fingerprint is at most radius bits from their item's."""
    bits = 64 // blocks
    probes = windows.select("*", F.posexplode(F.array(*(_block(F.col("fp"), k, bits) for k in range(blocks)))).alias("block", "value"))
    met = probes.join(index, ["item", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return met.drop("block", "value", "item_fp").distinct()


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger, of the elements of two arrays."""
    times = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda total, v: total + F.least(times(a, v), times(b, v)))
    return both / (F.size(a) + F.size(b) - both)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash (xxhash64), item_id, similarity, start and n_words (of the best window, in words) for each document and item it is contaminated with."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    bench = items.select(
        F.col(item_col).alias("item_id"), words(text_or_empty(item_text_col)).alias("item_words")
    ).where(F.size("item_words") > 0).distinct()
    bench = stored(
        bench.withColumn("item", F.xxhash64("item_id", F.array_join("item_words", " "))).withColumn("size", F.size("item_words")), "items"
    )
    sizes = sorted(r[0] for r in bench.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` rows
    found = [_leaks_of(texts, bench.where(F.least("size", F.lit(shingle)) == k), k, similarity, radius) for k in sizes]
    if not found:
        none = texts.crossJoin(bench.select("item_id")).limit(0)
        return none.select(
            "doc_id",
            F.lit(0).cast("long").alias("text_hash"),
            "item_id",
            F.lit(0.0).alias("similarity"),
            F.lit(0).alias("start"),
            F.lit(0).alias("n_words"),
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(windows: DataFrame, held: DataFrame, column: str, names: list[str], part) -> DataFrame:
    """windows (key, names) with their part of the document's array, which is cut before rows are made of them."""
    by_key = windows.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("all"))
    cut = F.transform("all", lambda x: F.struct(*(x[n].alias(n) for n in names), part(x).alias("part")))
    return by_key.join(held.select("key", column), "key").select("key", F.explode(cut).alias("x")).select("key", "x.*")


def _leaks_of(texts: DataFrame, bench: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]
    marks = bench.select("item", "size", F.posexplode(shingle_hashes(F.col("item_words"), k)).alias("q", "h"))
    marks = stored(marks, "item-shingles")
    distinct = stored(marks.select("h").distinct(), "item-hashes")

    # 1. Sieve. The id is kept in one field that is never null, so that null ids match as well.
    tokens = texts.select(*key, words(F.col("text")).alias("w"))
    seen = tokens.select(F.struct("doc_id", "text_hash").alias("key"), F.explode(shingle_hashes(F.col("w"), k)).alias("h"))
    touched = stored(seen.join(broadcast_if_small(distinct, HASHES), "h", "left_semi").select("key").distinct(), "touched")
    again = texts.select(F.struct(*key).alias("key"), "text").join(broadcast_if_small(touched), "key", "left_semi")
    held = again.select("key", words(F.col("text")).alias("w")).dropDuplicates(["key"]).withColumn("h", shingle_hashes(F.col("w"), k))
    held = stored(held, "held")

    # 2. Windows, with the items that put them there.
    hits = held.select("key", F.size("w").alias("n"), F.posexplode("h").alias("p", "h")).join(broadcast_if_small(marks.drop("q").distinct()), "h")
    same, along = Window.partitionBy("key", "item", "h").orderBy("p"), Window.partitionBy("key", "item").orderBy("p")
    near = lambda other: F.coalesce(F.abs(other - F.col("p")) < F.col("size"), F.lit(False))
    hits = hits.withColumn("again", near(F.lag("p").over(same)) | near(F.lead("p").over(same)))
    goes_on = (F.lag("p").over(along) == F.col("p") - 1) & ~F.lag("again").over(along)
    spots = hits.withColumn("on", F.coalesce(goes_on, F.lit(False))).where("NOT on")
    start = F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - F.col("size")))
    windows = spots.groupBy("key", "size", start.alias("start")).agg(F.collect_set("item").alias("items"))
    # 3. Fingerprints within the radius.
    part = lambda x: F.slice("h", x["start"] + 1, F.greatest(F.lit(1), x["size"] - k + 1))
    windows = _cut(windows, held, "h", ["size", "start", "items"], part)
    windows = windows.select("key", "size", "start", "items", simhash(F.col("part")).alias("fp")).select(
        "key", "size", "start", F.explode("items").alias("item"), "fp"
    )
    prints = bench.select("item", simhash(shingle_hashes(F.col("item_words"), k)).alias("item_fp")).distinct()
    index = broadcast_if_small(stored(hamming_index(prints, radius), "item-index"))
    pairs = stored(within_radius(windows, index, radius).select("key", "size", "start", "item"), "near")
    # 4. Verification.
    pairs = _cut(pairs, held, "w", ["size", "start", "item"], lambda x: F.slice("w", x["start"] + 1, x["size"]))
    sized = bench.select("item", "item_id", "item_words")
    pairs = pairs.join(broadcast_if_small(sized, weight=64 + 24 * F.size("item_words")), "item")
    pairs = pairs.select(
        "key",
        "item_id",
        "start",
        F.size("part").alias("n_words"),
        weighted_similarity(shingle_texts(F.col("part"), k), shingle_texts(F.col("item_words"), k)).alias("similarity"),
    )
    best = pairs.where(F.col("similarity") >= similarity).groupBy("key", "item_id").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words")).alias("b")
    )
    return best.select("key.doc_id", "key.text_hash", "item_id", (-F.col("b.s")).alias("similarity"), "b.start", "b.n_words")


def oracle() -> str:
    """All windows that hold a hit in SQL for DuckDB, without fingerprints; items of fewer words than a shingle aren't in the tables."""
    cut = lambda t: f"list_filter(string_split(regexp_replace(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    grams = lambda w: f"list_transform(range(len({w}) - {SHINGLE - 1}), lambda i: array_to_string({w}[i + 1:i + {SHINGLE}], ' '))"
    return f"""
        WITH d AS (SELECT doc_id, w, {grams('w')} AS g FROM (SELECT doc_id, {cut('text')} AS w FROM documents) WHERE len(w) >= {SHINGLE}),
        b AS (SELECT item_id, w, {grams('w')} AS g FROM (SELECT item_id, {cut('text')} AS w FROM benchmark) WHERE len(w) >= {SHINGLE}),
        ds AS (SELECT doc_id, len(w) AS n, unnest(g) AS s, generate_subscripts(g, 1) - 1 AS p FROM d),
        bs AS (SELECT DISTINCT item_id, len(w) AS size, unnest(g) AS s FROM b),
        hits AS (SELECT DISTINCT doc_id, item_id, n, size, p FROM ds JOIN bs USING (s)),
        win AS (SELECT doc_id, item_id, n, size, start, min(p) AS first FROM (
                SELECT *, unnest(range(greatest(0, least(p - size + {SHINGLE}, n - size)), greatest(0, least(p, n - size)) + 1)) AS start FROM hits)
            WHERE p >= start GROUP BY ALL),
        parts AS (SELECT doc_id, item_id, greatest(0, least(first, n - size)) AS start, least(size, len(d.w)) AS n_words,
                  d.g[win.start + 1:win.start + least(size, len(d.w)) - {SHINGLE - 1}] AS x, b.g AS y FROM win JOIN d USING (doc_id) JOIN b USING (item_id)),
        inter AS (SELECT doc_id, item_id, start, n_words, len(x) + len(y) AS both_sizes,
                  list_sum(list_transform(list_distinct(y), lambda v: least(len(list_filter(x, lambda z: z = v)), len(list_filter(y, lambda z: z = v))))) AS i FROM parts),
        scored AS (SELECT doc_id, item_id, start, n_words, CAST(i AS DOUBLE) / (both_sizes - i) AS similarity FROM inter)
        SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start, CAST(n_words AS INTEGER) AS n_words FROM scored WHERE similarity >= {SIMILARITY}
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""
