"""Writers: token and text files, results, resumable outputs, and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions import sequences as S
from echotrace.operators.matching import contributing_tokens, diff_opcodes
from echotrace.operators.results import DIMENSIONS, value_counts
from echotrace.sources.ranges import file_system
from echotrace.sources.shared import broadcast_if_small, exists, global_row_number, move, remove, stored


def write_tokens_and_text(df: DataFrame, folder: str, tokens: str = "selected_tokens", text: str = "detokenized_texts") -> None:
    """JSON lines of {input_ids} and of {text}, in two folders; an error if a column is missing."""
    missing = [c for c in (tokens, text) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df.select(F.col(tokens).alias("input_ids")).write.json(f"{folder}/token.jsonl")
    df.select(F.col(text).alias("text")).write.json(f"{folder}/text.jsonl")


def write_rank_files(records: DataFrame, folder: str, order: list[Column], world: int = 1) -> int:
    """JSON lines by rank, as `world` generators would leave them: row i in the given order goes to rank i % world, as its next line.

    rankN.jsonl is a folder of part files in order, so a rank's rows needn't pass one task. Returns the number of records.
    """
    return sum(write_rank_grid(records.withColumn("_folder", F.lit(".")), folder, "_folder", order, world).values())


def write_rank_grid(records: DataFrame, base: str, folder: str, order: list[Column], world: int = 1) -> dict[str, int]:
    """The same for many cells at once, each in the folder below base that the column `folder` names: one sort and one write for all.

    Returns the number of records of each folder. Rows are numbered over all cells, and a cell's first number is taken off.
    """
    spark = records.sparkSession
    numbered, _ = global_row_number(records.withColumnRenamed(folder, "_folder"), [F.col("_folder"), *order], "_at")
    cells = numbered.groupBy("_folder").agg(F.min("_at"), F.count("*")).collect()  # a row for each cell
    cells = sorted((r[0], r[1], r[2]) for r in cells)
    if not cells:
        return {}
    known = spark.createDataFrame([(name, i, first) for i, (name, first, _) in enumerate(cells)], "_folder string, _cell int, _first long")
    dealt = numbered.join(broadcast_if_small(known), "_folder").withColumn("_at", F.col("_at") - F.col("_first"))
    dealt = dealt.withColumn("_rank", (F.col("_at") % world).cast("int")).drop("_folder", "_first")
    place, made = ["_cell", "_rank", "_at"], f"{base}/.{uuid.uuid4().hex}"
    dealt.repartitionByRange(*place).sortWithinPartitions(*place).drop("_at").write.partitionBy("_cell", "_rank").json(made)
    for i, (name, _, n) in enumerate(cells):
        for rank in range(world):
            target = "/".join(x for x in (base, name, f"rank{rank}.jsonl") if x != ".")
            if rank < n:
                move(spark, f"{made}/_cell={i}/_rank={rank}", target)
            else:
                write_bytes(f"{target}/part-00000.json", b"")  # a rank without a row
    remove(spark, made)
    return {name: n for name, _, n in cells}


def write_if_missing(df: Callable[[], DataFrame], path: str, spark: SparkSession) -> bool:
    """Writes JSON lines to path unless a whole result is there already; whether it wrote. What a broken run left is replaced."""
    if exists(spark, f"{path}/_SUCCESS"):
        return False
    df().write.mode("overwrite").json(path)
    return True


def write_bytes(path: str, content: bytes) -> None:
    """One file, written by the caller; a file that is there is replaced."""
    system, at = file_system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(content)


def _part_writer(folder: str, suffix: str, head: Callable[[int], bytes], element: str):
    """Writes the first column of each partition as one file of fixed elements; its head is made when their number is known."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        task = TaskContext.get()
        part, made = task.partitionId(), f"{at}/.part-{task.partitionId():05d}-{task.taskAttemptId()}.tmp"
        system.create_dir(at, recursive=True)
        n = 0
        with system.open_output_stream(made) as out:
            out.write(head(0))
            for batch in batches:
                values = batch.column(0)
                values = values.flatten() if pa.types.is_list(values.type) else values
                out.write(values.to_numpy(zero_copy_only=False).astype(element).tobytes())
                n += len(values)
        if head(0):
            # The head has one size for every number, so it is put in front of what was written.
            with system.open_input_stream(made) as source, system.open_output_stream(f"{made}2") as out:
                source.read(len(head(0)))
                out.write(head(n))
                while raw := source.read(1 << 22):
                    out.write(raw)
            system.delete_file(made)
            made += "2"
        system.move(made, f"{at}/{suffix.replace('*', f'{part:05d}')}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return write


def write_token_records(df: DataFrame, folder: str, tokens: str = "tokens") -> None:
    """Token sequences of one length as records of little-endian 32-bit ids: a file for each partition, in its order."""
    df.select(F.col(tokens).cast("array<int>")).mapInArrow(_part_writer(folder, "part-*.bin", lambda n: b"", "<i4"), "n long").count()


def _vector_head(n: int) -> bytes:
    head = f"{{'descr': '<i8', 'fortran_order': False, 'shape': ({n},), }}"
    return b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + head.ljust(117).encode() + b"\n"


def write_index_vector(df: DataFrame, folder: str, name: str, value: str = "value") -> None:
    """A column of integers as one-dimensional .npy files, one for each partition, in its order; name: with a * for the part's number."""
    df.select(F.col(value).cast("long")).mapInArrow(_part_writer(folder, name, _vector_head, "<i8"), "n long").count()


def existing_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The distinct keys of what is at path, or None if nothing is; what is there and can't be read is an error."""
    return spark.read.parquet(path).select(*keys).distinct() if exists(spark, path) else None


def write_missing(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys aren't at path yet, partitioned by the keys: a run that broke off can be repeated."""
    there = existing_keys(df.sparkSession, path, keys)
    rows = df if there is None else df.join(broadcast_if_small(stored(there, "keys")), keys, "left_anti")
    rows.write.mode("append").partitionBy(*keys).parquet(path)


def write_results(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("expr").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def results_from_dict(spark: SparkSession, tree: dict) -> DataFrame:
    """The tidy table of expr -> rep -> offset -> prefix -> suffix -> metric -> scores."""
    rows = []

    def walk(node, keys):
        if len(keys) < len(DIMENSIONS) + 1:
            for key, below in node.items():
                walk(below, [*keys, key])
        else:
            values = node["scores"] if isinstance(node, dict) else node
            rows.extend((str(keys[0]), *map(int, keys[1:5]), i, keys[5], float(v)) for i, v in enumerate(values))

    walk(tree, [])
    schema = T.StructType([T.StructField("expr", T.StringType()), *(T.StructField(d, T.IntegerType()) for d in DIMENSIONS[1:]), T.StructField("seq_idx", T.LongType()), T.StructField("metric", T.StringType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


#: How the report shows a part of a sequence.
_STYLE = ".pair{display:grid;grid-template-columns:4em 1fr 4em 1fr;font-family:monospace}.lines{text-align:right;color:#666}.text{white-space:pre-wrap}.delete{background:#fdd}.insert{background:#dfd}.shared{background:#ffc}"


def _span(kind: Column | str, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit('<span class="'), kind, F.lit('">'), S.escape_markup(text), F.lit("</span>"))


def _numbered(text: Column, body: Column) -> Column:
    """A column of line numbers and the text beside it."""
    numbers = F.array_join(F.sequence(F.lit(1), S.line_count(text).cast("int")), "\n")
    return F.concat(F.lit('<div class="lines">'), numbers, F.lit('</div><div class="text">'), body, F.lit("</div>"))


def generation_report(
    pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", decode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """keys, rouge_l and html: both sequences side by side with line numbers, once with the parts of their diff and once with the
    tokens of their longest common subsequence marked, and the Rouge-L score.

    decode puts an array of tokens together; tokens are joined by spaces without it.
    """
    decode = decode or (lambda t: F.array_join(F.transform(t, lambda x: x.cast("string")), " "))
    steps = diff_opcodes(pairs.select(*keys, a, b), keys, a, b).join(pairs.select(*keys, a, b), keys)
    part = lambda c, k: F.slice(c, F.col(f"start{k}") + 1, F.col(f"end{k}") - F.col(f"start{k}"))
    kinds = [F.when(F.col("tag") == "equal", "equal").otherwise(kind) for kind in ("delete", "insert")]
    shown = [F.when(F.col(f"end{k}") > F.col(f"start{k}"), _span(kind, decode(part(c, k)))).otherwise("").alias(f"s{k}") for (k, c), kind in zip(((1, a), (2, b)), kinds, strict=True)]
    steps = steps.select(*keys, "start1", "start2", *shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start1", "start2", "s1", "s2"))).alias("steps")
    )
    common = contributing_tokens(pairs, keys, a, b).select(*keys, "n", "positions1", "positions2")
    rows = pairs.select(*keys, a, b).join(common, keys).join(steps, keys, "left")
    marked = lambda c, at: S.highlighted(F.col(c), F.col(at), '<span class="shared">', "</span>")
    diff = lambda k: F.coalesce(F.array_join(F.transform("steps", lambda x: x[f"s{k}"]), ""), F.lit(""))
    score = S.rouge_l(F.col("n"), F.size(a), F.size(b))
    texts = [decode(F.col(c)) for c in (a, b)]
    views = [(diff(1), diff(2)), (marked(a, "positions1"), marked(b, "positions2"))]
    grids = [F.concat(F.lit('<div class="pair">'), _numbered(texts[0], left), _numbered(texts[1], right), F.lit("</div>")) for left, right in views]
    head = F.concat(F.lit(f"<style>{_STYLE}</style><p>Rouge-L: "), F.format_string("%.4f", score), F.lit("</p>"))
    return rows.select(*keys, score.alias("rouge_l"), F.concat(head, *grids).alias("html"))


def report_names(experiment: Column, rep: Column, seq_idx: Column, offset: Column, at: Column) -> Column:
    """The name of a sequence's report file."""
    number = lambda x: x.cast("string")
    return F.concat(
        experiment,
        F.lit("_generation_rep"),
        number(rep),
        F.lit("_seq"),
        number(seq_idx),
        F.lit("_offset"),
        number(offset),
        F.lit("_"),
        S.timestamp_text(at),
        F.lit(".html"),
    )


def write_reports(reports: DataFrame, folder: str, name: str = "name", html: str = "html") -> None:
    """One file for each row, written where the row is; a task that runs twice writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{at}/.{file}.{attempt}.tmp") as out:
                    out.write(content.encode())
                system.move(f"{at}/.{file}.{attempt}.tmp", f"{at}/{file}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    reports.select(F.col(name).cast("string"), F.col(html).cast("string")).mapInArrow(write, "name string").count()


def token_count_lines(tokens: DataFrame, token: str, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """token, count and line: how often each contributing token occurs, as a row of a text table, in the order of tokens."""
    counts = value_counts(tokens, F.col(token), "token")
    text = S.visible_white_space((decode or (lambda t: t.cast("string")))(F.col("token")))
    return counts.select("token", "count", F.format_string("%8s | %-15s | %5d", F.col("token").cast("string"), text, "count").alias("line"))
