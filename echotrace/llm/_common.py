"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.sources.shared import broadcast_if_small, global_row_number, new_path, remove, scratch, shared_dir, stored  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose crc32(doc_id as text) mod 4 is 2; never learnt from. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, also for functions that were pickled by value."""
    home = sys.modules.setdefault("_echotrace_process_cache", types.ModuleType("_echotrace_process_cache"))
    return home.__dict__.setdefault(name, {})


def smallest_hashes(rows: DataFrame, label: str, limits: Column) -> DataFrame:
    """label and h of the distinct rows (label, h) with the smallest h of each label, as many as limits says (a column of label).

    The numbers of rows are exact. Numbers are given in buckets of h first, so that no task sees all rows of a label.
    """
    slim, at = rows.select(label, "h").distinct(), F.row_number()
    by_bucket = Window.partitionBy(label, F.pmod(F.col("h"), F.lit(64))).orderBy("h")
    few = slim.withColumn("_n", at.over(by_bucket)).where(F.col("_n") <= limits)
    return few.withColumn("_n", at.over(Window.partitionBy(label).orderBy("h"))).where(F.col("_n") <= limits).drop("_n")
