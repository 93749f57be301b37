"""The evaluation of an experiment grid in one call: paths to tidy scores to cell statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.operators import generate, results
from echotrace.sources import sinks
from echotrace.sources.inference import read_rank_files, require_paths


@dataclass(frozen=True)
class EvalConfig:
    """What to evaluate; a dimension that doesn't vary is a list of one value."""

    base_path: str
    expr: str
    repetitions: list[int]
    policy: str = "greedy"
    offsets: list[int] = field(default_factory=lambda: [0])
    prefix_lengths: list[int] = field(default_factory=lambda: [500])
    suffix_lengths: list[int] = field(default_factory=lambda: [500])

    def paths(self) -> list[str]:
        """The folder of each cell of the grid."""
        base = f"{self.base_path}/{self.expr}/inference"
        return [
            f"{base}/offset_{o}_prefix_{p}_suffix_{s}/rep_{r}_{self.policy}"
            for r in self.repetitions
            for o in self.offsets
            for p in self.prefix_lengths
            for s in self.suffix_lengths
        ]


@dataclass(frozen=True)
class Results:
    """Tidy scores (expr, rep, offset, prefix, suffix, seq_idx, metric, score), and the questions that are asked of them."""

    scores: DataFrame

    def statistics(self) -> DataFrame:
        """Mean, population standard deviation and maximum of each metric of each cell."""
        return results.cell_statistics(self.scores, [*results.DIMENSIONS, "metric"])

    def cell(self, metric: str | None = None, **dimensions) -> DataFrame:
        return results.cell(self.scores, metric, **dimensions)

    def dimensions(self) -> DataFrame:
        return results.dimension_values(self.scores, [*results.DIMENSIONS, "metric"])

    def by_repetition(self, metric: str, vary: str, values: list, **fixed) -> DataFrame:
        return results.repetition_pivot(self.scores, metric, vary, values, **fixed)

    def listing(self, metric: str | None = None, **fixed) -> DataFrame:
        return results.repetition_listing(self.scores, metric, **fixed)

    def save(self, path: str) -> None:
        sinks.write_results(self.scores, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Results:
        return cls(sinks.read_results(spark, path))

    @classmethod
    def from_dict(cls, spark: SparkSession, tree: dict) -> Results:
        return cls(sinks.results_from_dict(spark, tree))


def _scores(spark: SparkSession, configs: Iterable[EvalConfig]) -> DataFrame:
    """Scores of all cells from one scan; an error if a cell has no files. A cell's own suffix length cuts both sequences."""
    paths = [p for c in configs for p in c.paths()]
    require_paths(spark, paths)
    rows = read_rank_files(spark, paths)
    sides = [F.slice(c, 1, F.col("len_suffix").cast("int")).alias(c) for c in ("true_suffix", "generated_suffix")]
    keys = ["expr", "rep", "offset", F.col("len_prefix").alias("prefix"), F.col("len_suffix").alias("suffix"), "seq_idx"]
    return generate.evaluate(rows.select(*keys, *sides, "nll_mean"), results.DIMENSIONS)


def eval_expr(spark: SparkSession, config: EvalConfig) -> Results:
    """Rouge-L, type-token ratios and NLL of every sequence of every cell of one experiment."""
    return Results(_scores(spark, [config]))


def eval_rouge_ttr(
    spark: SparkSession,
    base_path: str,
    experiments: list[str],
    repetitions: list[int],
    policy: str = "greedy",
    offset: int = 0,
    prefix: int = 500,
    suffix: int = 500,
) -> Results:
    """The same for several experiments at one offset, prefix and suffix."""
    return Results(_scores(spark, [EvalConfig(base_path, e, repetitions, policy, [offset], [prefix], [suffix]) for e in experiments]))
