"""Inference with an injected generator: windows in, sparse records out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions import sequences as S

#: Takes prefixes (each with the begin sign first), the number of new ids and the policy; returns new ids and their logits or NLL.
Generator = Callable[[list[list[int]], int, str], list[tuple[list[int], list[float]]]]


def inference_records(
    df: DataFrame,
    keys: list[str],
    ids: str,
    offset: int,
    prefix: int,
    suffix: int,
    generator: Generator,
    policy: str = "greedy",
    bos: int = 128000,
) -> DataFrame:
    """keys and a sparse record for each sequence that is long enough; NLL values must not be negative."""
    rows = df.where(F.size(ids) >= offset + prefix + suffix).withColumn("_w", S.token_window(F.col(ids), offset, prefix, suffix))
    rows = rows.select(*keys, S.prefix_of(F.col("_w"), prefix).alias("prefix"), S.suffix_of(F.col("_w"), prefix).alias("true_suffix"))
    rows = rows.withColumn("_input", S.with_bos(F.col("prefix"), bos))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = generator([list(map(int, x)) for x in batch["_input"]], suffix, policy)
            nll = [list(map(float, x)) for _, x in found]
            if any(v < 0 for x in nll for v in x):
                raise ValueError("negative NLL")
            out = batch.drop(columns="_input").assign(generated_suffix=[x for x, _ in found], nll=nll)
            yield out.assign(
                nll_mean=[float(np.mean(x)) if x else None for x in nll],
                nll_std=[float(np.std(x, ddof=1)) if len(x) > 1 else None for x in nll],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("_input").schema.fields)
    return rows.mapInPandas(run, fields + ", generated_suffix array<int>, nll array<double>, nll_mean double, nll_std double")


def step_to_epoch(step: Column, steps_per_epoch: int = 75) -> Column:
    return step / steps_per_epoch


def evaluate(records: DataFrame, dimensions: list[str], suffix: int | None = None) -> DataFrame:
    """The tidy scores (Rouge-L, TTR_ref, TTR_gen, NLL) of inference records: one projection over all cells."""
    from echotrace.operators.matching import rouge_and_ttr
    from echotrace.operators.results import tidy

    keys = [*dimensions, "seq_idx"]
    scores = rouge_and_ttr(records, [*keys, "nll_mean"], "true_suffix", "generated_suffix", suffix)
    wide = scores.select(
        *keys,
        F.col("rouge_l").alias("Rouge-L"),
        F.col("ttr_ref").alias("TTR_ref"),
        F.col("ttr_gen").alias("TTR_gen"),
        F.col("nll_mean").alias("NLL"),
    )
    return tidy(wide, keys, ["Rouge-L", "TTR_ref", "TTR_gen", "NLL"])
