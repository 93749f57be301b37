"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Rows are numbered 0..N-1 in ascending (doc_id, text hash) order. The permutation works on pairs (l, r) with
l < a and r < b, where a = ceil(sqrt(N)) and b = ceil(N / a): half-rounds add a keyed hash of one half to the other,
modulo its size, which can be undone and so is a bijection on 0..a*b-1. Images of N or more are walked on until they
fall below N; a*b - N < a, so at most one row in sqrt(N) walks. Shard and slot are remainder and quotient of the image
by the number of shards: counts differ by one at most and slots have no gaps. Any row's place follows from its number
alone, and the shuffle can be repeated from the seed.

Defined results: null ids sort first; null text has size 1 (no bytes, plus 1) and the crc32 of the empty text; repeated rows
each get a place of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import global_row_number, text_or_empty

SHARDS, SEED, ROUNDS = 16, 42, 4
PRIME, MULTIPLIER = 2147483647, 1103515245


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[int]:
    """Two keys below 2^31 for each round."""
    keys, x = [], (seed * 2654435761 + 97) % PRIME
    for _ in range(2 * rounds):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _scrambled(x: Column, key: Column) -> Column:
    return (x * MULTIPLIER + key) % PRIME


def _folded(y: Column, key: Column) -> Column:
    return (y.bitwiseXOR(F.shiftright(y, 15)) * 69621 + key) % PRIME


def _stepped(x: Column, a: int, b: int, keys: list[int]) -> Column:
    """One application to 0..a*b-1 as one expression; for the few rows that walk."""

    def turn(s: Column, k: Column) -> Column:
        left = (s["l"] + _folded(_scrambled(s["r"], k["p"]), k["p"])) % a
        right = (s["r"] + _folded(_scrambled(left, k["q"]), k["q"])) % b
        return F.struct(left.alias("l"), right.alias("r"))

    rounds = F.array(
        *(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for p, q in zip(keys[::2], keys[1::2], strict=True))
    )
    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])


def permuted(rows: DataFrame, x: str, n: int, name: str, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """rows with a column of the image of column x (0 <= x < n) under the permutation of 0..n-1.

    Each half-round is a projection of its own, so that no expression is computed twice and all stay in generated code.
    """
    a, b = _sides(n)
    keys = round_keys(seed, rounds)
    rows = rows.withColumns({"_l": ((F.col(x) - F.col(x) % b) / b).cast("long"), "_r": F.col(x) % b})
    for i, key in enumerate(keys):
        this, other, size = ("_l", "_r", a) if i % 2 == 0 else ("_r", "_l", b)
        rows = rows.withColumn("_y", _scrambled(F.col(other), F.lit(key)))
        rows = rows.withColumn(this, (F.col(this) + _folded(F.col("_y"), F.lit(key))) % size)
    rows = rows.withColumn("_z", F.col("_l") * b + F.col("_r"))
    if a * b > n:
        # A walk visits no point twice and so leaves 0..n-1 for a*b - n steps at most: the sequence is always long enough.
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(a * b - n)), F.col("_z"), lambda z, _: F.when(z < n, z).otherwise(_stepped(z, a, b, keys))
        )
        rows = rows.withColumn("_z", F.when(F.col("_z") < n, F.col("_z")).otherwise(walk))
    return rows.withColumn(name, F.col("_z")).drop("_l", "_r", "_y", "_z")


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of each row of docs."""
    text = text_or_empty(text_col)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    numbered, n = global_row_number(slim, [F.col("doc_id"), F.col("_hash")], "row_number")
    image = permuted(numbered, "row_number", n, "_image", seed)
    return image.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_image") % shards).cast("int").alias("shard"),
        F.floor(F.col("_image") / shards).cast("long").alias("slot"),
    )
