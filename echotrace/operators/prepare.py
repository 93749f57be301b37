"""Corpus preparation: first-wins dedup, length filter, excerpts, buckets and replicas, order, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotrace.functions.tokenizers import Tokenizer
from echotrace.sources.shared import global_row_number

BUCKET = 500
REPETITIONS = [2**i for i in range(7, 12)]


def dedup_first(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by the order columns. The candidates are combined before the shuffle."""
    everything = F.struct(*df.columns)
    named = [c.alias(f"_k{i}") for i, c in enumerate(key)]
    return df.groupBy(*named).agg(F.min_by(everything, F.struct(*order)).alias("_first")).select("_first.*")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or an error when it runs if a key occurs twice (checked by one aggregation)."""
    check = df.agg((F.count(key) - F.count_distinct(key)).alias("more")).select(
        F.when(F.col("more") > 0, F.raise_error(F.lit(f"{key} isn't unique"))).otherwise(F.lit(0)).alias("_ok")
    )
    return df.crossJoin(F.broadcast(check)).where("_ok = 0").drop("_ok")  # one row


def minimum_length(df: DataFrame, text: str, end: int) -> DataFrame:
    return df.where(F.length(text) >= end)


def excerpt_offset(key: Column, size: Column, n: int, seed: int = 42) -> Column:
    """A start from 0 to size - n that follows from key and seed alone, so it is the same at any partitioning."""
    return F.pmod(key * 2654435761 + seed * 40503, size - n + 1)


def excerpts(df: DataFrame, key: str, tokens: Column, n: int, seed: int = 42) -> DataFrame:
    """df with n tokens from its offset (start, excerpt); rows with fewer tokens go."""
    rows = df.withColumn("_t", tokens).where(F.size("_t") >= n).withColumn("start", excerpt_offset(F.col(key), F.size("_t"), n, seed))
    return rows.withColumn("excerpt", F.slice("_t", (F.col("start") + 1).cast("int"), F.lit(n))).drop("_t")


def round_trip(df: DataFrame, ids: str, tokenizer: Tokenizer, n: Column | int) -> DataFrame:
    """Rows whose n tokens are n again after they were put together and cut once more."""
    return df.where(F.size(tokenizer.encode(tokenizer.decode(F.col(ids)))) == n)


def take_first(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows; an error if there are fewer."""
    if (found := df.limit(n).count()) < n:
        raise ValueError(f"{n} rows are asked for, there are {found}")
    return df.orderBy(order).limit(n)


def buckets(df: DataFrame, position: str, size: int = BUCKET) -> DataFrame:
    """df with bucket and place in it, from a 0-based position."""
    return df.withColumns(
        {"bucket": F.floor(F.col(position) / size).cast("long"), "place": F.pmod(F.col(position), F.lit(size)).cast("long")}
    )


def replicate(df: DataFrame, position: str, repetitions: list[int], size: int = BUCKET) -> DataFrame:
    """The i-th bucket repeated repetitions[i] times, block after block: rep, copy (from 0), place; rows beyond the last bucket go."""
    counts = F.array(*map(F.lit, repetitions))
    rows = buckets(df, position, size).where(F.col("bucket") < len(repetitions)).withColumn(
        "rep", F.get(counts, F.col("bucket").cast("int"))
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("rep") - 1)))


def enough_rows(n_rows: int, repetitions: list[int], size: int = BUCKET) -> None:
    if len(repetitions) * size > n_rows:
        raise ValueError(f"{len(repetitions)} buckets of {size} need {len(repetitions) * size} rows, there are {n_rows}")


def restored_order(position_in_rank: Column, rank: Column, world: Column | int) -> Column:
    """The place in the source of a row that was dealt round-robin to `world` ranks."""
    return position_in_rank * world + rank


def split_by_position(df: DataFrame, order: list[Column], train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """df with seq_idx and split: floor(n * train) first rows, floor(n * validation) next, the rest test; with train = 1 all are train."""
    if train + validation > 1 + 1e-9:
        raise ValueError("the shares are more than 1")
    rows, n = global_row_number(df, order, "seq_idx")
    a = int(n * train + 1e-9)
    b = a + int(n * validation + 1e-9)
    return rows.withColumn("split", F.when(F.col("seq_idx") < a, "train").when(F.col("seq_idx") < b, "validation").otherwise("test"))


def sampled_indices(spark: SparkSession, total: int, step: int = BUCKET, extra: int = 100, seed: int = 42) -> DataFrame:
    """index: first, every step-th, last, and `extra` others drawn by a hash; only first and last up to step rows."""
    rows = spark.range(total).withColumnRenamed("id", "index")
    fixed = F.col("index").isin(0, total - 1) | ((F.col("index") % step == 0) & F.lit(total > step))
    base = rows.where(fixed)
    if total <= step:
        return base.distinct()
    return base.union(rows.where(~fixed).orderBy(F.xxhash64("index", F.lit(seed)), "index").limit(extra)).distinct()


def missing_indices(df: DataFrame, column: str, total: int) -> DataFrame:
    """The numbers 0..total-1 that don't occur."""
    return df.sparkSession.range(total).withColumnRenamed("id", column).join(df.select(F.col(column).cast("long")), column, "left_anti")


def modular_lookup(samples: DataFrame, index: str, base: DataFrame, base_index: str, size: int) -> DataFrame:
    """Each replicated sample with its base row: index % size = base_index."""
    return samples.withColumn("_at", F.pmod(F.col(index), F.lit(size)).cast("long")).join(
        base.withColumnRenamed(base_index, "_at"), "_at"
    ).withColumnRenamed("_at", base_index)


def mixture_weights(df: DataFrame, source: str, amount: Column) -> DataFrame:
    """source, amount, weight: the share of each source in the total."""
    sums = df.groupBy(source).agg(F.sum(amount).alias("amount"))
    return sums.withColumn("weight", F.col("amount") / F.sum("amount").over(Window.partitionBy(F.lit(0))))  # a row for each source


def mixed(
    sources: dict[str, tuple[DataFrame, float]], total: int, order: list[str], name: str = "source", rest: str | None = None, strict: bool = True
) -> DataFrame:
    """total rows of all sources by their weights: each source's first rows in a fixed order, from the beginning again where it has too few.

    Shares are rounded down and what is left goes to the source `rest`, or else to the largest remainders, so the numbers add up.
    A source with a share and no row is an error, or gives nothing if not strict.
    """
    weights = sum(w for _, w in sources.values())
    exact = {s: total * w / weights for s, (_, w) in sources.items()}
    counts = {s: int(x + 1e-9) for s, x in exact.items()}
    left = total - sum(counts.values())
    for s in [rest] * left if rest else sorted(exact, key=lambda s: (counts[s] - exact[s], s))[:left]:
        counts[s] += 1
    parts = []
    for s, (df, _) in sources.items():
        numbered, n = global_row_number(df, [F.col(c) for c in order], "_at")
        if strict and counts[s] and not n:
            raise ValueError(f"{s} has a weight and no row")
        wanted = df.sparkSession.range(counts[s]).select(F.col("id").alias("sample"), (F.col("id") % max(1, n)).alias("_at"))
        parts.append(wanted.join(numbered, "_at").drop("_at").withColumn(name, F.lit(s)))
    return reduce(DataFrame.unionByName, parts)


def checkpoint_schedule(spark: SparkSession, steps_per_epoch: int, epochs: int, every: int, batch: int) -> DataFrame:
    """step and consumed samples: each every-th step up to the last, and the last."""
    last = steps_per_epoch * epochs
    steps = spark.range(every, last + 1, every).withColumnRenamed("id", "step").union(spark.range(last, last + 1)).distinct()
    return steps.withColumn("consumed", F.col("step") * batch)


def fused_row_mapping(spark: SparkSession, groups: int, heads_per_group: int) -> DataFrame:
    """part (q, k, v), row of the split matrix and row of the fused one, in units of one head."""
    rows = spark.range(groups * (heads_per_group + 2)).withColumnRenamed("id", "fused_row")
    group, inside = F.floor(F.col("fused_row") / (heads_per_group + 2)), F.col("fused_row") % (heads_per_group + 2)
    part = F.when(inside < heads_per_group, "q").when(inside == heads_per_group, "k").otherwise("v")
    return rows.select(
        part.alias("part"), F.when(inside < heads_per_group, group * heads_per_group + inside).otherwise(group).alias("row"), "fused_row"
    )


def gate_up_mapping(spark: SparkSession, rows: int) -> DataFrame:
    """part (gate, up), row of the split matrix and row of the fused one, which holds gate in its first half."""
    if rows % 2:
        raise ValueError("a fused matrix has an even number of rows")
    fused = spark.range(rows).withColumnRenamed("id", "fused_row")
    first = F.col("fused_row") < rows // 2
    return fused.select(
        F.when(first, "gate").otherwise("up").alias("part"),
        F.when(first, F.col("fused_row")).otherwise(F.col("fused_row") - rows // 2).alias("row"),
        "fused_row",
    )


def split_fused(matrix: DataFrame, row: str, heads_per_group: int) -> DataFrame:
    """Rows of a fused matrix (a group's query heads, its key head, its value head, in units of one head) as rows of q, k and v: part and part_row are added.

    A projection of each row, so a matrix of any size is laid out anew where its rows lie.
    """
    size = heads_per_group + 2
    group, inside = F.floor(F.col(row) / size), F.col(row) % size
    part = F.when(inside < heads_per_group, "q").when(inside == heads_per_group, "k").otherwise("v")
    at = F.when(inside < heads_per_group, group * heads_per_group + inside).otherwise(group)
    return matrix.withColumns({"part": part, "part_row": at.cast("long")})


def fuse(parts: DataFrame, row: str, heads_per_group: int) -> DataFrame:
    """The other way round: the row of the fused matrix from part and part_row."""
    size, at = heads_per_group + 2, F.col("part_row")
    head = F.when(F.col("part") == "q", F.floor(at / heads_per_group) * size + at % heads_per_group)
    return parts.withColumn(row, head.when(F.col("part") == "k", at * size + heads_per_group).otherwise(at * size + heads_per_group + 1).cast("long"))


def split_gate_up(matrix: DataFrame, row: str, rows: int) -> DataFrame:
    """Rows of a fused matrix of `rows` rows, gate in its first half, as rows of gate and up: part and part_row are added."""
    if rows % 2:
        raise ValueError("a fused matrix has an even number of rows")
    first = F.col(row) < rows // 2
    return matrix.withColumns({"part": F.when(first, "gate").otherwise("up"), "part_row": F.when(first, F.col(row)).otherwise(F.col(row) - rows // 2)})


def parameter_grid(spark: SparkSession, **dimensions: list) -> DataFrame:
    """All combinations of short lists of parameters."""
    grid = spark.range(1).select()
    for name, values in dimensions.items():
        grid = grid.crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name)))
    return grid
