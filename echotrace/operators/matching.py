"""Operators on pairs of token sequences: rows with key columns and two array columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotrace.functions import kernels
from echotrace.functions import sequences as S
from echotrace.functions.kernels import Frontier


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, a, b: the tokens of each turn and of the next one."""
    following = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", S.tokens(F.col("text")).alias("a"), F.lead("text").over(following).alias("next"))
    return rows.where("next is not null").select("conv_id", "turn", "role", "a", S.tokens(F.col("next")).alias("b"))


def match_points(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, i, j (0-based) of every two equal tokens: an equi-join on keys and token."""
    left = pairs.select(*keys, F.posexplode(a).alias("i", "token"))
    right = pairs.select(*keys, F.posexplode(b).alias("j", "token"))
    return left.join(right, [*keys, "token"]).select(*keys, "i", "j")


def maximal_runs(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, length, start1, start2 of every common run that can't be made longer: islands on a diagonal i - j."""
    points = match_points(pairs, keys, a, b).withColumn("d", F.col("i") - F.col("j"))
    diagonal = Window.partitionBy(*keys, "d").orderBy("i")
    island = points.withColumn("island", F.col("i") - F.row_number().over(diagonal))
    runs = island.groupBy(*keys, "d", "island").agg(
        F.count("*").cast("int").alias("length"), F.min("i").alias("start1"), F.min("j").alias("start2")
    )
    return runs.drop("d", "island")


def longest_common_substring(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", how: str = "relational") -> DataFrame:
    """keys, length, start1, end1, start2, end2; the first in row-major order of ends wins, and all are 0 without a match.

    how: 'relational' (a join; for selective tokens) or 'kernel' (one table row at a time in Arrow batches; for tokens
    that repeat so often that the join would hold most of the table's cells).
    """
    if how == "kernel":
        return pairs.select(*keys, kernels.longest_run_udf(F.col(a), F.col(b)).alias("m")).select(*keys, "m.*")
    if how != "relational":
        raise ValueError(f"how is relational or kernel, not {how}")
    runs = maximal_runs(pairs, keys, a, b)
    order = F.struct(-F.col("length"), F.col("start1") + F.col("length"), F.col("start2") + F.col("length"))
    best = runs.groupBy(*keys).agg(F.min_by(F.struct("length", "start1", "start2"), order).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    n, s1, s2 = F.col("m.length"), F.col("m.start1"), F.col("m.start2")
    return pairs.select(*keys).join(best, keys, "left").select(
        *keys,
        zero(n).alias("length"),
        zero(s1).alias("start1"),
        zero(s1 + n).alias("end1"),
        zero(s2).alias("start2"),
        zero(s2 + n).alias("end2"),
    )


def longest_matches(
    pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", min_length: int = 2, how: str = "relational"
) -> DataFrame:
    """keys, match: the longest common substring as a struct, or null where it is shorter than min_length."""
    found = longest_common_substring(pairs, keys, a, b, how)
    return found.select(*keys, F.when(F.col("length") >= min_length, F.struct("length", "start1", "end1", "start2", "end2")).alias("match"))


def all_common_substrings(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", min_length: int = 2) -> DataFrame:
    """A row for each of the non-overlapping common substrings, longest first in `rank`, with its tokens."""
    found = pairs.select(*keys, a, F.posexplode(kernels.disjoint_matches_udf(F.col(a), F.col(b), F.lit(min_length))).alias("rank", "m"))
    return found.select(*keys, "rank", "m.*", F.slice(a, F.col("m.start1") + 1, F.col("m.length")).alias("tokens"))


def match_values(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", min_length: int = 2) -> DataFrame:
    """keys, values: the tokens of all common substrings of each pair, longest first; an empty array without one."""
    found = F.transform(
        kernels.disjoint_matches_udf(F.col(a), F.col(b), F.lit(min_length)), lambda m: F.slice(F.col(a), m["start1"] + 1, m["length"])
    )
    return pairs.select(*keys, found.alias("values"))


def relaxed_spans(
    pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", min_consecutive: int = 3, max_edits: int = 1
) -> DataFrame:
    """A row for every pair of windows with at most max_edits edits, also those inside longer ones."""
    found = kernels.relaxed_spans_udf(F.col(a), F.col(b), F.lit(min_consecutive), F.lit(max_edits))
    return pairs.select(*keys, F.explode(found).alias("m")).select(*keys, "m.*")


def relaxed_matches(
    pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", min_consecutive: int = 3, max_edits: int = 1
) -> DataFrame:
    """A row for each match with at most max_edits edits that isn't inside a longer one with no more edits."""
    found = pairs.select(
        *keys, a, b, F.explode(kernels.relaxed_matches_udf(F.col(a), F.col(b), F.lit(min_consecutive), F.lit(max_edits))).alias("m")
    )
    part = lambda c, k: F.slice(c, F.col(f"m.start{k}") + 1, F.col(f"m.end{k}") - F.col(f"m.start{k}"))
    return found.select(*keys, "m.*", part(a, 1).alias("tokens1"), part(b, 2).alias("tokens2"))


def drop_contained(spans: DataFrame, keys: list[str], order: str, width: int = 4096) -> DataFrame:
    """Spans (length, edits, start1, end1, start2, end2) of each key that no span before them, by length and then `order`, contains with no more edits.

    Containment with no more edits is transitive, so a span that was itself dropped drops nothing new. A task sweeps spans in order
    of start1 with the few of them that may still contain one to come. The first sequence is cut into segments of `width`
    places, so a key with very many spans is dealt to many tasks; a span is judged where it starts and known wherever it reaches.
    """
    names, place = spans.columns, lambda c: F.floor(c / width)
    reach = F.sequence(place(F.col("start1")), place(F.greatest(F.col("end1") - 1, F.col("start1"))))
    rows = spans.withColumn("_segment", F.explode(reach)).withColumn("_own", F.col("_segment") == place(F.col("start1")))
    rows = rows.repartition(*keys, "_segment").sortWithinPartitions(*keys, "_segment", "start1", F.desc("length"), order)
    numbers = ["start1", "end1", "start2", "end2", "edits", "length", order]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, frontier = None, None
        for batch in batches:
            kept = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "_segment", "_own", *numbers)]
            for row in zip(*columns, strict=True):
                if row[: len(keys) + 1] != at:
                    at, frontier = row[: len(keys) + 1], Frontier()
                kept.append(frontier.admits(*row[len(keys) + 2 :]) and row[len(keys) + 1])
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    return rows.mapInArrow(sweep, spans.schema)


def rouge_and_ttr(pairs: DataFrame, keys: list[str], reference: str = "a", candidate: str = "b", suffix: int | None = None) -> DataFrame:
    """keys, rouge_l, ttr_ref, ttr_gen; suffix: only the first so many tokens of both. The ratios are null for an empty side."""
    x, y = (F.slice(c, 1, suffix) if suffix else F.col(c) for c in (reference, candidate))
    rows = pairs.select(*keys, x.alias("x"), y.alias("y"))
    rows = rows.withColumn("lcs", kernels.lcs_length_udf("x", "y"))
    return rows.select(
        *keys,
        "lcs",
        S.rouge_l(F.col("lcs"), F.size("x"), F.size("y")).alias("rouge_l"),
        S.type_token_ratio(F.col("x")).alias("ttr_ref"),
        S.type_token_ratio(F.col("y")).alias("ttr_gen"),
    )


def contributing_tokens(pairs: DataFrame, keys: list[str], reference: str = "a", candidate: str = "b") -> DataFrame:
    """keys, n, tokens, positions1, positions2 of one longest common subsequence."""
    rows = pairs.select(*keys, reference, kernels.lcs_positions_udf(F.col(reference), F.col(candidate)).alias("p"))
    return rows.select(
        *keys,
        F.size("p").alias("n"),
        F.transform("p.pos1", lambda i: F.get(F.col(reference), i)).alias("tokens"),
        F.col("p.pos1").alias("positions1"),
        F.col("p.pos2").alias("positions2"),
    )


def ngram_osa(pairs: DataFrame, keys: list[str], n: int, a: str = "a", b: str = "b", pad=0) -> DataFrame:
    """keys, at, distance, normalized: optimal string alignment of the n-grams at the same place of both sequences.

    normalized divides by the larger number of elements that aren't padding, at least 1.
    """
    grams = pairs.select(*keys, F.arrays_zip(S.ngrams(F.col(a), n).alias("x"), S.ngrams(F.col(b), n).alias("y")).alias("z"))
    aligned = grams.select(*keys, F.posexplode("z").alias("at", "g")).where(
        "g.x is not null and g.y is not null"
    ).select(*keys, "at", "g.x", "g.y")
    real = F.greatest(S.non_padding(F.col("x"), pad), S.non_padding(F.col("y"), pad), F.lit(1))
    return aligned.withColumn("distance", kernels.osa_udf("x", "y")).select(
        *keys, "at", "distance", (F.col("distance") / real).alias("normalized")
    )


def diff_opcodes(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", only: str | None = None) -> DataFrame:
    """keys, tag, start1, end1, start2, end2 of a diff; only: one tag, such as replace."""
    rows = pairs.select(*keys, F.explode(kernels.opcodes_udf(F.col(a), F.col(b))).alias("o")).select(*keys, "o.*")
    return rows.where(F.col("tag") == only) if only else rows
