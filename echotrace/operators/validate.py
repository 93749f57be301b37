"""Data checks: each returns the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import sequences as S
from echotrace.operators.matching import diff_opcodes
from echotrace.operators.prepare import BUCKET, modular_lookup, sampled_indices


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule for each rule (true where broken; null counts as not broken) that a row breaks."""
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def inference_rules(prefix: int, suffix: int, vocabulary: int) -> dict[str, Column]:
    """Rules of an inference record."""
    outside = lambda c: F.exists(F.col(c), lambda t: (t < 0) | (t >= vocabulary))
    names = ("prefix", "true_suffix", "generated_suffix")
    return {
        "fields": F.greatest(*(F.col(c).isNull() for c in (*names, "nll", "nll_mean", "nll_std"))),
        "prefix length": F.size("prefix") != prefix,
        "suffix length": (F.size("true_suffix") != suffix) | (F.size("generated_suffix") != suffix),
        "nll length": F.size("nll") != F.size("generated_suffix"),
        "nll sign": F.exists("nll", lambda x: x < 0),
        "token range": outside("prefix") | outside("true_suffix") | outside("generated_suffix"),
    }


def wrong_length(df: DataFrame, keys: list[str], seq: str, n: int) -> DataFrame:
    return df.where(F.size(seq) != n).select(*keys, F.size(seq).alias("length"))


def value_hits(df: DataFrame, keys: list[str], seq: str, value, before: int = 5, after: int = 5) -> DataFrame:
    """keys, at (0-based) and context of each place where value stands, such as a begin sign in the middle."""
    hits = df.select(*keys, seq, F.explode(S.positions(F.col(seq), value)).alias("at"))
    return hits.select(*keys, "at", S.context(F.col(seq), F.col("at"), before, after).alias("context"))


def expected_tokens(df: DataFrame, seq: str, rep: int, bucket: int = 500, sequence: int = 8192) -> DataFrame:
    """n_tokens, expected and ok: the tokens of a replicated bucket against rep * bucket * sequence."""
    return df.agg(F.coalesce(F.sum(F.size(seq)), F.lit(0)).alias("n_tokens")).select(
        "n_tokens", F.lit(rep * bucket * sequence).alias("expected"), (F.col("n_tokens") == rep * bucket * sequence).alias("ok")
    )


def index_lengths(df: DataFrame, kind: str, total: int) -> DataFrame:
    """kind, n, expected, ok: document and sample indexes hold all rows, a shuffle index one less."""
    expected = total - (kind == "shuffle")
    return df.agg(F.count("*").alias("n")).select(
        F.lit(kind).alias("kind"), "n", F.lit(expected).alias("expected"), (F.col("n") == expected).alias("ok")
    )


def differing_samples(
    spark: SparkSession,
    records: DataFrame,
    base: DataFrame,
    total: int,
    tokens: str = "tokens",
    index: str = "index",
    base_index: str = "index",
    size: int = BUCKET,
    extra: int = 100,
    seed: int = 42,
) -> DataFrame:
    """index, tag, start1, end1, start2, end2: where the tokens of sampled records differ from those of their base row (index % size).

    records hold replicated sequences by index; the sample is that of sampled_indices. Sequences of equal tokens give no row.
    """
    chosen = sampled_indices(spark, total, size, extra, seed).select(F.col("index").alias("_i"))
    picked = records.join(F.broadcast(chosen), F.col(index) == F.col("_i")).select(
        F.col(index).alias("index"), F.col(tokens).alias("a")
    )  # about a hundred rows and one in `size`
    pairs = modular_lookup(picked, "index", base.select(F.col(base_index).alias("_base"), F.col(tokens).alias("b")), "_base", size)
    return diff_opcodes(pairs.where(~F.col("a").eqNullSafe(F.col("b"))), ["index"]).where("tag <> 'equal'")


def differing_windows(windows: DataFrame, source: DataFrame, keys: list[str], window: str, tokens: str, offset: int) -> DataFrame:
    """Rows whose window isn't the part of their source's tokens that begins at offset."""
    joined = windows.join(source.select(*keys, F.col(tokens).alias("_source")), keys)
    return joined.where(~F.col(window).eqNullSafe(F.slice("_source", offset + 1, F.size(window)))).drop("_source")
