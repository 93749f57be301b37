"""A training corpus from documents: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each result as Parquet to
the shared folder and reads it again. All but the last return the columns of documents.

Rows need no key: decisions are joined on the id together with a hash of the text, null ids as a value of their own, and rows
that are the same in both count as one. Added columns get a name that docs doesn't have, so no column is lost or changed.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm import decontaminate, exact_dedup, lang_id, packing, simhash_dedup
from echotrace.llm._common import broadcast_if_small, held_out, new_path, remove, scratch, stored, text_or_empty
from echotrace.llm.queries import tokenizer_path

#: Documents whose language is predicted with a lower score are rejected, and those without a letter.
MIN_LANGUAGE_SCORE = 0.3


def _unused(docs: DataFrame) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    return next(name for n in count() if (name := f"_stage{n}") not in taken)


def _key(doc_id: str, mark: Column) -> Column:
    return F.concat_ws("|", mark.cast("string"), F.col(doc_id).cast("string"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages."""
    model, own = lang_id.learn(docs.where(~held_out())), _unused(docs)
    guess = docs.withColumn(own, lang_id.predicted(model, F.col("text").cast("string")))
    known = (F.col(f"{own}.lang_pred") != lang_id.UNDETERMINED) & (F.col(f"{own}.score") >= MIN_LANGUAGE_SCORE)
    return guess.where(known).drop(own)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of equal texts."""
    own = _unused(docs)
    kept = exact_dedup.exact_dedup(docs, keep="smallest").where("kept").select(_key("keep_id", F.col("text_sha256")).alias(own))
    keyed = docs.withColumn(own, _key("doc_id", F.sha2(text_or_empty().cast("binary"), 256)))
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of linked fingerprints."""
    own = _unused(docs)
    marked = stored(docs.withColumn(own, simhash_dedup.simhash_signed(F.col("text").cast("string"))), "marked")
    rows = marked.select("doc_id", F.col(own).alias("fp"))
    groups = simhash_dedup.fingerprint_components(rows).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    kept = rows.join(groups, "fp").groupBy("root").agg(first).select("first.*").select(_key("doc_id", F.col("fp")).alias(own))
    keyed = marked.withColumn(own, _key("doc_id", F.col(own)))
    return keyed.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    own = _unused(docs)
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stored(leaks.select(_key("doc_id", F.col("text_hash")).alias(own)).distinct(), "leaks")
    keyed = docs.withColumn(own, _key("doc_id", F.xxhash64(text_or_empty())))
    return keyed.join(broadcast_if_small(leaks), own, "left_anti").drop(own)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 1024 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Fingerprint components and tokenizers aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
