"""Corpus preparation in one call: excerpts of books, and buckets of replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import sequences as S
from echotrace.functions.tokenizers import WHITE_SPACE, Tokenizer
from echotrace.operators import prepare
from echotrace.sources import sinks
from echotrace.sources.shared import exists, global_row_number, stored


def excerpt_rows(
    books: DataFrame,
    tokenizer: Tokenizer = WHITE_SPACE,
    n_tokens: int = 8191,
    n_rows: int | None = None,
    start: int = 0,
    end: int | None = None,
    seed: int = 42,
    key: str = "id",
    text: str = "text",
) -> DataFrame:
    """key, selected_tokens and detokenized_texts of an excerpt of n_tokens from each book.

    The first of books with one id; those with fewer than `end` characters go; tokens of the characters from start to end (all of them
    without end); an offset that follows from the id; rows whose excerpt isn't n_tokens again once it was put
    together and cut go; then the first n_rows by key, or an error if there are fewer.
    """
    first = prepare.dedup_first(books.select(key, text), [F.col(key)], [key, text])
    part = F.col(text)
    if end is not None:
        first, part = prepare.minimum_length(first, text, end), S.character_range(part, start, end)
    number = F.col(key) if dict(books.dtypes)[key] in ("bigint", "int", "smallint") else F.xxhash64(key)
    keyed = first.withColumn("_number", number.cast("long"))
    found = prepare.excerpts(keyed, "_number", tokenizer.encode(part), n_tokens, seed)
    found = prepare.round_trip(found, "excerpt", tokenizer, n_tokens)
    found = found.select(key, F.col("excerpt").alias("selected_tokens"), tokenizer.decode(F.col("excerpt")).alias("detokenized_texts"))
    if n_rows is None:
        return found
    return prepare.take_first(stored(found, "excerpts"), key, n_rows)


def create_excerpts(books: DataFrame, folder: str, tokenizer: Tokenizer = WHITE_SPACE, **options) -> bool:
    """Writes excerpt_rows() as token.jsonl and text.jsonl in folder; nothing is done, and False returned, if both are there."""
    if all(exists(books.sparkSession, f"{folder}/{name}.jsonl/_SUCCESS") for name in ("token", "text")):
        return False
    rows = stored(excerpt_rows(books, tokenizer, **options), "excerpt-rows")
    sinks.write_tokens_and_text(rows, folder)
    return True


def create_replicas(
    spark: SparkSession,
    rows: DataFrame,
    folder: str,
    repetitions: list[int],
    order: list[str],
    size: int = prepare.BUCKET,
    tokens: str = "selected_tokens",
    text: str = "detokenized_texts",
) -> list[int]:
    """Writes bucket i of rows as rep_{k}_token.jsonl and, repeated k times block after block, rep_{k}_text.jsonl for the i-th of repetitions.

    An error if there are too few rows. Buckets that are there already are left as they are; returns the repetitions that were written.
    """
    numbered, n = global_row_number(rows.select(*dict.fromkeys([*order, tokens, text])), [F.col(c) for c in order], "_at")
    prepare.enough_rows(n, repetitions, size)
    written = []
    for i, k in enumerate(repetitions):
        bucket = numbered.where((F.col("_at") >= i * size) & (F.col("_at") < (i + 1) * size))
        copies = bucket.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        ordered = lambda df, keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        wrote = [
            sinks.write_if_missing(
                lambda b=bucket: ordered(b, ["_at"]).select(F.col(tokens).alias("input_ids")), f"{folder}/rep_{k}_token.jsonl", spark
            ),
            sinks.write_if_missing(
                lambda c=copies: ordered(c, ["_copy", "_at"]).select(F.col(text).alias("text")), f"{folder}/rep_{k}_text.jsonl", spark
            ),
        ]
        if any(wrote):
            written.append(k)
    return written
