"""Inference records: JSON lines by rank, with their dimensions in the path and their order in the deal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from echotrace.sources.shared import broadcast_if_small, exists, stored

_IDS = T.ArrayType(T.IntegerType())
DENSE = T.StructType().add("prefix", _IDS).add("true_suffix", _IDS).add("generated_suffix", _IDS)
SPARSE = T.StructType([*DENSE.fields, T.StructField("nll", T.ArrayType(T.DoubleType())), T.StructField("nll_mean", T.DoubleType()), T.StructField("nll_std", T.DoubleType())])


def _number(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast("long")


def path_columns(path: Column, prefix: str = "prefix", suffix: str = "suffix") -> list[Column]:
    """offset, prefix, suffix, rep, policy and rank of a record's path; null where the path has none."""
    numbers = {"offset": "offset_(\\d+)", prefix: "prefix_(\\d+)", suffix: "suffix_(\\d+)", "rep": "rep_(\\d+)"}
    policy = F.nullif(F.regexp_extract(path, "rep_\\d+_([A-Za-z]+)", 1), F.lit(""))
    return [
        *(_number(path, p).alias(name) for name, p in numbers.items()),
        policy.alias("policy"),
        _number(path, "rank(\\d+)\\.jsonl").alias("rank"),
    ]


def checkpoint_columns(path: Column) -> list[Column]:
    return [_number(path, "step=(\\d+)").alias("step"), _number(path, "consumed(?:_samples)?=(\\d+)").alias("consumed")]


def experiment_columns(name: Column) -> list[Column]:
    """size, kind, k, h, batch and sequence of an experiment's name."""
    text = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return [
        text("llama_([^_]+)_").alias("size"),
        F.when(F.contains(name, F.lit("_Standard_")), "standard").otherwise("goldfish").alias("kind"),
        *(_number(name, p).alias(c) for c, p in (("k", "_K_(\\d+)"), ("h", "_H_(\\d+)"), ("batch", "_GBS_(\\d+)"), ("sequence", "_SEQ_(\\d+)"))),
    ]


def read_rank_files(spark: SparkSession, path: str | list[str], schema: T.StructType = SPARSE, order: bool = True) -> DataFrame:
    """All records below path with their path columns (expr, the experiment's folder; len_prefix and len_suffix for the lengths) and, for each
    directory of ranks, seq_idx: the place in the source before the deal. Without order, records come as they are read and have no seq_idx.

    rankN.jsonl is a file or a folder of part files in order of their names; ranks are compared as numbers, so ten and more ranks
    are right as well, ranks may have different numbers of rows, and a rank without a row counts as one of the world.

    Spark reads a file in splits and keeps the rows of a split in order. The records are stored once, as another read could cut
    the files elsewhere (splits depend on the executors that are there); counts of the splits, a row for each, are added up along
    each rank, and a record's place is the first one of its split and its row in it. No rows are sorted or moved for it.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.json*"}
    rows = spark.read.schema(schema).options(**options).json(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    expr = F.nullif(F.regexp_extract("_path", "([^/]+)/inference/", 1), F.lit("")).alias("expr")
    dims = [expr, *path_columns(F.col("_path"), "len_prefix", "len_suffix")]
    if not order:
        return rows.select("*", *dims).drop("_path", "_block")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "records")
    folder = F.regexp_replace("_path", "/rank\\d+\\.jsonl.*$", "").alias("_dir")
    rank = _number(F.col("_path"), "rank(\\d+)\\.jsonl").alias("_rank")
    splits = rows.groupBy("_path", "_block").agg(F.min("_row").alias("_least"), F.count("*").alias("_n")).select("*", folder, rank)
    # What stands before a split in its rank: a window over splits.
    before = Window.partitionBy("_dir", "_rank").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least"))
    files = spark.read.format("binaryFile").options(**options).load(path).select(F.col("_metadata.file_path").alias("_path"))
    files = files.select(folder, rank).distinct()
    world = files.groupBy("_dir").agg(F.count("*").alias("_world"))  # a row for each directory
    splits = stored(splits.join(world, "_dir").select("_path", "_block", "_start", "_world", "_rank"), "splits")
    place = (F.col("_row") + F.col("_start")) * F.col("_world") + F.col("_rank")
    rows = rows.join(broadcast_if_small(splits), ["_path", "_block"]).withColumn("seq_idx", place)
    return rows.select("*", *dims).drop("_path", "_block", "_row", "_start", "_world", "_rank")


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """An error that names the paths that aren't there."""
    if missing := [p for p in paths if not exists(spark, p)]:
        raise FileNotFoundError(f"{len(missing)} of {len(paths)} paths are missing, such as {missing[0]}")


def first_match(spark: SparkSession, pattern: str) -> str:
    """The first path, by name, that a glob matches; an error if none does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    names = sorted(status.getPath().toString() for status in found or [])
    if not names:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return names[0]


def list_checkpoints(spark: SparkSession, base: str) -> DataFrame:
    """step, consumed and path of the checkpoint folders below base, in numeric order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("path")
    ).distinct()
    return files.select("path", *checkpoint_columns(F.col("path"))).where("step is not null").orderBy("step", "consumed")


def latest_checkpoint(spark: SparkSession, base: str) -> DataFrame:
    return list_checkpoints(spark, base).orderBy(F.desc("step"), F.desc("consumed")).limit(1)


def exactly_one(df: DataFrame) -> DataFrame:
    """df if it has one row; an error otherwise."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("nothing found" if n == 0 else "more than one found")
    return df


def read_requested_buckets(spark: SparkSession, path: str, repetitions: list[int], schema: T.StructType | None = None) -> DataFrame:
    """Bucket files rep_{k}_token.jsonl of the requested repetitions; rep is a column. Other files aren't read."""
    schema = schema or T.StructType().add("input_ids", _IDS)
    names = [f"{path}/rep_{k}_token.jsonl" for k in sorted(repetitions)]
    return spark.read.schema(schema).json(names).withColumn("rep", _number(F.col("_metadata.file_path"), "rep_(\\d+)_token"))


def read_lines(spark: SparkSession, path: str, schema: T.StructType = SPARSE) -> DataFrame:
    """Records with _corrupt_record set where a line isn't valid JSON."""
    with_errors = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path)
    return lines.select(
        F.from_json("value", with_errors, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")
    ).select("r.*")


def read_harness_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, task, accuracy, error of evaluation-harness documents: hellaswag and the mmlu groups."""
    pair = T.StructType().add("acc,none", T.DoubleType()).add("acc_stderr,none", T.DoubleType())
    groups = ["mmlu", "mmlu_humanities", "mmlu_other", "mmlu_social_sciences", "mmlu_stem"]
    group_type = T.StructType()
    for g in groups:
        group_type = group_type.add(g, pair)
    schema = T.StructType().add("results", T.StructType().add("hellaswag", pair)).add("groups", group_type)
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    found = [("hellaswag", "results.hellaswag"), *((g, f"groups.{g}") for g in groups)]
    rows = F.array(*(F.struct(F.lit(t).alias("task"), F.col(f"{c}.`acc,none`").alias("accuracy"), F.col(f"{c}.`acc_stderr,none`").alias("error")) for t, c in found))
    return docs.select("path", F.explode(rows).alias("x")).select("path", "x.*")
