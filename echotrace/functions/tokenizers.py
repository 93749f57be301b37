"""Tokenizers as pairs of column functions, so that any of them can be injected where texts become ids or ids texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions import sequences as S


@dataclass(frozen=True)
class Tokenizer:
    """encode gives an array of tokens or ids without special ones and without truncation; decode puts such an array together."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


#: White-space tokens, joined by spaces.
WHITE_SPACE = Tokenizer(S.tokens, lambda t: F.array_join(t, " "))


def chunked(whole: int = 6, part: int = 4) -> Tokenizer:
    """White-space characters and words, words of more than `whole` characters in parts of `part`: built-in expressions only.

    As with learnt vocabularies, tokens taken from the middle of a word may be others once they are cut again.
    """
    def encode(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit("(\\s|\\S+)"), F.lit(1))
        split = F.transform(
            words,
            lambda w: F.when(F.length(w) <= whole, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(\\S{{1,{part}}})"), F.lit(1))),
        )
        return F.flatten(split)

    return Tokenizer(encode, lambda t: F.array_join(t, ""))


def injected(encode: Callable[[list[str]], list[list[int]]], decode: Callable[[list[list[int]]], list[str]]) -> Tokenizer:
    """A tokenizer of Python functions on batches, such as a library's; they run in Arrow batches."""

    def encoded(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(["" if t is None else t for t in texts]))

    def decoded(ids: pd.Series) -> pd.Series:
        return pd.Series(decode([[] if x is None else [int(i) for i in x] for x in ids]))

    return Tokenizer(F.pandas_udf(encoded, T.ArrayType(T.IntegerType())), F.pandas_udf(decoded, T.StringType()))


def from_file(path: str) -> Tokenizer:
    """A tokenizer file of the tokenizers library, loaded once by each worker."""
    loaded: dict = {}

    def library():
        if path not in loaded:
            from tokenizers import Tokenizer as Library

            loaded[path] = Library.from_file(path)
        return loaded[path]

    return injected(
        lambda texts: [e.ids for e in library().encode_batch(texts, add_special_tokens=False)],
        lambda ids: library().decode_batch(ids, skip_special_tokens=False),
    )
