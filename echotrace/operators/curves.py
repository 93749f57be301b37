"""Checkpoint curves, experiment frames, totals and printed summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotrace.operators.matching import all_common_substrings, longest_common_substring


def with_split(records: DataFrame, cell: list[str], order: str, train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """records with the split of each by its place in its cell; with train = 1 all are train. A cell is one evaluation set."""
    if abs(train - 1) < 1e-9:
        return records.withColumn("split", F.lit("train"))
    if train + validation > 1 + 1e-9:
        raise ValueError("the shares are more than 1")
    n = F.count("*").over(Window.partitionBy(*cell))
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(order)) - 1
    a, b = F.floor(n * train + 1e-9), F.floor(n * validation + 1e-9)
    return records.withColumn("split", F.when(at < a, "train").when(at < a + b, "validation").otherwise("test"))


def split_curves(
    records: DataFrame,
    model: str = "model",
    step: str = "step",
    order: str = "seq_idx",
    a: str = "a",
    b: str = "b",
    how: str = "longest",
    train: float = 0.9,
    validation: float = 0.05,
    steps_per_epoch: int = 75,
) -> DataFrame:
    """model, step, split, epoch, avg_length: the mean longest common substring, or with how = 'all' the mean over sequences of
    their mean common substring, sequences without one left out."""
    keys = [model, step, order]
    if how == "longest":
        lengths = longest_common_substring(records, keys, a, b).select(*keys, F.col("length").alias("value"))
    elif how == "all":
        each = all_common_substrings(records, keys, a, b).groupBy(*keys).agg(F.avg("length").alias("value"))
        lengths = records.select(*keys).join(each, keys, "left")
    else:
        raise ValueError(f"how is longest or all, not {how}")
    rows = with_split(lengths, [model, step], order, train, validation)
    return rows.groupBy(model, step, "split").agg(F.avg("value").alias("avg_length")).withColumn("epoch", F.col(step) / steps_per_epoch)


def collected(frames: dict[tuple[str, int], DataFrame], required: str) -> DataFrame:
    """One frame of all that have the required column, with exp and rep; an error if none has."""
    kept = [df.withColumns({"exp": F.lit(exp), "rep": F.lit(rep)}) for (exp, rep), df in frames.items() if required in df.columns]
    if not kept:
        raise ValueError(f"no frame has {required}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), kept)


def replication_totals(spark: SparkSession, repetitions: list[int], bucket: int = 500, sequence: int = 8192, corpus: int = 0) -> DataFrame:
    """sequences and tokens of the replicated buckets, all tokens, and the share of the replicated ones."""
    sums = spark.range(1).select(F.explode(F.array(*(F.lit(r).cast("long") for r in repetitions))).alias("r")).agg(
        (F.sum("r") * bucket).alias("sequences")
    )
    tokens = F.col("sequences") * sequence
    return sums.select(
        "sequences", tokens.alias("tokens"), (tokens + corpus).alias("total_tokens"), (tokens / (tokens + corpus)).alias("share")
    )


def replicated_share(df: DataFrame, position: str, tokens: Column, repetitions: list[int], bucket: int) -> DataFrame:
    """sequences and tokens of the replicas of a corpus's buckets, tokens of the whole corpus, and the replicas' share of both together.

    Row `position` lies in bucket position // bucket, which is repeated repetitions[that] times; one aggregate, nothing is replicated for it.
    """
    counts = F.array(*(F.lit(r).cast("long") for r in repetitions))
    rep = F.coalesce(F.get(counts, F.floor(F.col(position) / bucket).cast("int")), F.lit(0))
    sums = df.agg(F.sum(rep).alias("sequences"), F.sum(rep * tokens).alias("tokens"), F.sum(tokens.cast("long")).alias("corpus_tokens"))
    return sums.withColumn("share", F.col("tokens") / (F.col("tokens") + F.col("corpus_tokens")))


def summary_lines(statistics: DataFrame, labels: list[str], mean: str = "mean", std: str = "std") -> DataFrame:
    """line: the labels and mean ± std of each row."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in labels]
    return statistics.select(F.concat_ws(" ", *parts, F.format_string("%.4f ± %.4f", mean, std)).alias("line"))
