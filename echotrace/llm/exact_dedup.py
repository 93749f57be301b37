"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only.

A run is what one partition of the input holds. Rounds are binomial: in each, runs 2k and 2k + 1 (fan_in neighbours) exchange their
entries by digest and merge to run k, until one run is left. The sort aggregate of a task merges its own sorted entries
before the exchange, and the one behind it merges those that meet; a run is spread over the shuffle's partitions by digest, so no task
ever holds a whole run. An entry is a digest, the identifier that stays, the number of copies and, where a digest
occurs more than once, the text: entries merge only if their texts are equal byte for byte, so at every level the
identifier that is retained is a verified one, and different texts of one digest stay apart to the end.

Which digests may occur more than once is known beforehand from a count of 64-bit hashes of digests; one too many there costs a
text but changes nothing. A row whose hash occurs once has no entry to merge with, so it is a group of its own and neither it
nor its text moves. Going down, each row takes its group's result through its own run's entry, so a frequent text is one row
of a run in that join as well.

Copies of a frequent text are one entry of each run from the first merge on, whatever their ids.

Defined results: null text counts as empty; null ids lose to any id, and a group of null ids only has a null keep_id and
its first row stays; of rows with equal id and text exactly one stays; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import broadcast_if_small, stored, text_or_empty

FAN_IN, AT_ONCE = 2, 2


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def first_round(entries: DataFrame, key: list[str], aggs: list[Column], fan_in: int = FAN_IN) -> DataFrame:
    """Merges the entries of each run before their exchange, and neighbouring runs behind it."""
    return entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("run", *key).agg(*aggs)


def merged_runs(entries: DataFrame, key: list[str], aggs: list[Column], runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """The one run that is left after rounds of merges; aggs combine entries into entries.

    Runs that merge within the next AT_ONCE rounds meet in one exchange, each digest in a place of its own, so those rounds are
    aggregates over sorted entries that lie together.
    """
    while runs > 1:
        rounds = next(k for k in range(1, AT_ONCE + 1) if k == AT_ONCE or fan_in**k >= runs)
        home = F.floor(F.col("run") / fan_in**rounds).cast("int")
        entries = entries.withColumn("home", home).repartition("home", *key)
        for _ in range(rounds):
            runs, merged = -(-runs // fan_in), F.floor(F.col("run") / fan_in).cast("int")
            entries = entries.withColumn("run", merged).groupBy("home", "run", *key).agg(*aggs)
        entries = entries.drop("home")
    return entries.drop("run")


def exact_dedup(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, digest=_sha256
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; keep: 'smallest' or 'largest' id stays."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    code = F.xxhash64(digest(F.col("text")))
    repeated = texts.select(code.alias("code")).groupBy("code").count().where("count > 1").select("code")
    repeated = broadcast_if_small(stored(repeated, "repeated-digests").withColumn("again", F.lit(True)))

    # Rows with their run. The text goes with those of repeated digests only.
    rows = texts.withColumn("run", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", digest(F.col("text"))).withColumn("code", F.xxhash64("digest"))
    sha256 = [] if digest is _sha256 else [_sha256(F.col("text")).alias("sha256")]
    body = F.when(F.col("again"), F.col("text")).alias("body")  # null: the digest occurs once
    rows = stored(rows.join(repeated, "code", "left").select("doc_id", "place", "run", "digest", *sha256, body), "rows")
    text_sha256 = F.lower(F.hex("sha256" if sha256 else "digest")).alias("text_sha256")
    single = rows.where("body is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256
    )
    rows = rows.where("body is not null")

    # max/min of (has id, id) prefers rows with an id for either order.
    known = F.col("doc_id").isNull().alias("none") if keep == "smallest" else F.col("doc_id").isNotNull().alias("some")
    rank = F.struct(known, F.col("doc_id"), F.col("place"))
    key = ["digest", "body"]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    first = stored(first_round(rows, key, [best(rank).alias("stay"), F.count("*").alias("n")], fan_in), "first-round")
    runs = -(-runs // fan_in)
    top = stored(merged_runs(first, key, [best("stay").alias("stay"), F.sum("n").alias("n")], runs, fan_in), "groups")

    # Texts go down the tree only if there are two to a digest.
    if top.groupBy("digest").count().where("count > 1").isEmpty():
        key = ["digest"]
    entries = first.select("run", *key).join(top.select(*key, "stay", "n"), key)
    rows = rows if key == ["digest", "body"] else rows.drop("body")
    rows = rows.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
    found = rows.join(entries, ["run", *key])
    kept = (F.col("stay.place") == F.col("place")).alias("kept")
    found = found.select("doc_id", F.col("stay.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept, text_sha256)
    return single.unionByName(found)
