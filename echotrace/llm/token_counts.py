"""Token counts of every prefix of every text, by dynamic programming over prefixes.

For merges by rank (sentencepiece BPE) two facts hold. The encoding of a prefix without its last token is the encoding of the
shorter prefix that it covers; and a row of tokens is an encoding if every two neighbours are the encoding of what they spell
together. So the last token of a prefix is the only piece that ends there and suits the last token of the prefix before it, and
the count is that prefix's count and one more: one pass gives the exact count at every place. A character that the model
doesn't know counts as its bytes.

No piece of the models meant here holds a blank behind another character (this is looked up; without it a text is one word), so
a prefix's count is the sum over the words before and the place in its own word, and words are worked out once. What is
stored for a text is one signed byte for each code point: by how much the count changes there. The functions below answer
from that table how many tokens a cut text has and where a budget ends, without the text and without encoding.

Defined results: null counts as the empty text, which has no token; repeated rows each keep theirs; null ids stay; an empty
table gives an empty result; other columns are ignored; texts of any length are worked through word by word, and a word
without end place by place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.llm._common import process_cache
from echotrace.llm._tokens import slices

LIMIT = 4096
#: Bounds of what a worker remembers: words, their length, pairs of pieces, and states.
_WORDS, _LENGTH, _PAIRS, _STATES = 300_000, 64, 1_000_000, 300_000
_BLANK = "▁"


class PrefixCounter:
    """Counts of a sentencepiece BPE model with plain normalisation (blanks are marked and one stands before the text)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        rules = model.normalizer_spec
        marked = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or rules.precompiled_charsmap or not marked or kinds - {1, 2, 3, 6}:
            raise ValueError(f"{path} isn't a BPE model with plain normalisation")
        normal = sorted((p for p in model.pieces if p.type == 1), key=lambda p: -p.score)
        self.rank = {p.piece: i for i, p in enumerate(normal)}
        whole = any(_BLANK in p.lstrip(_BLANK) for p in self.rank)
        self._word = re.compile(".+" if whole else f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+", re.DOTALL)
        self._begins = {p[:i] for p in self.rank for i in range(1, len(p))}
        #: States by what they hold, each with the steps from it that were made.
        self._states: dict[tuple, tuple[tuple, dict]] = {}
        self._first = ((("", "", 0),), {})
        self._last: dict[str, tuple[str, str] | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by the rule itself, best rank first and then from the left, and the last two that were merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            rank, at = min((self.rank.get(x + y, len(self.rank)), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(last)]
        return parts, last

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece that were merged last; None for a piece that merging never makes."""
        if piece not in self._last:
            parts, last = self.merged(piece)
            self._last[piece] = last if len(parts) == 1 else None
        return self._last[piece]

    def suits(self, a: str, b: str) -> bool:
        """Whether a and b are the encoding of a + b."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= _PAIRS:
                self._pairs.clear()
            found = self._pairs[a, b] = self._undisturbed(a, b)
        return found

    def _undisturbed(self, a: str, b: str) -> bool:
        """Goes back through the merges of a and b that touch their border, the latest first, and looks whether the parts that meet there would have been merged before."""
        x, y, before = a, b, len(self.rank)
        while True:
            if self.rank.get(x + y, len(self.rank)) < before:
                return False
            of_x, of_y = (self.rank[p] if len(p) > 1 else -1 for p in (x, y))
            if of_x < 0 and of_y < 0:
                return True
            # Of equal ranks the left one is merged first: x before the border, the border before y.
            if of_x > of_y:
                made, before = self.last_merge(x), of_x
                x = made[1]
            else:
                made, before = self.last_merge(y), of_y + 1
                y = made[0]
            if any(self.rank[p] >= self.rank["".join(made)] for p in made if len(p) > 1):
                return self.merged(a + b)[0] == [a, b]  # ranks don't grow from part to whole here: merge once and compare

    def _step(self, state: tuple, sign: str) -> tuple[tuple, int]:
        """The state after one more code point, and by how much the count changes.

        A state is all that later places can ask for: for each place where a piece may have begun that goes on, the begun
        piece, the last token before it, and the count there against the count here.
        """
        change, last, begun = None, None, []
        for start, before, count in state:
            piece = start + sign
            whole = len(piece) == 1 or (piece in self.rank and self.last_merge(piece) is not None)
            if change is None and whole and (not before or self.suits(before, piece)):
                last = piece
                change = count + (1 if piece in self.rank else len(piece.encode("utf-8", "surrogatepass")))
            if piece in self._begins:
                begun.append((piece, before, count))
        return (*((piece, before, count - change) for piece, before, count in begun), ("", last, 0)), change

    def changes(self, word: str) -> bytes:
        """By how much the count changes at each code point of a word, as signed bytes. Steps that were made once are looked up."""
        at, out = self._first, bytearray()
        for sign in word:
            known = at[1].get(sign)
            if known is None:
                state, change = self._step(at[0], sign)
                if len(self._states) >= _STATES:
                    self._states.clear()
                    self._first[1].clear()
                known = at[1][sign] = (self._states.setdefault(state, (state, {})), change & 255)
            at = known[0]
            out.append(known[1])
        return bytes(out)

    def _known(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            found = self.changes(word)
            if len(word) <= _LENGTH:
                if len(self._words) >= _WORDS:
                    self._words.clear()
                self._words[word] = found
        return found

    def prefixes(self, text: str) -> bytes:
        """By how much the count changes at each code point of a text, as signed bytes; their sum is the count of the whole text."""
        if not text:
            return b""
        raw = b"".join(map(self._known, self._word.findall(_BLANK + text.replace(" ", _BLANK))))
        return np.int8(np.frombuffer(raw[:2], dtype=np.int8).sum()).tobytes() + raw[2:]


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a model file."""
    cache = process_cache("prefix_counters")
    if path not in cache:
        cache[path] = PrefixCounter(path)
    return cache[path]


def token_prefixes(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and changes (a signed byte for each code point) of each row; to be stored for the functions below."""
    names = ["doc_id", "n_bytes", "n_tokens", "changes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(model).prefixes
        for batch in batches:
            for a, b in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                raw = [prefixes(x) for x in rows.column("text").to_pylist()]
                counts = [int(np.frombuffer(x, dtype=np.int8).sum(dtype=np.int64)) for x in raw]
                arrays = [rows.column("doc_id"), rows.column("n_bytes"), pa.array(counts, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, changes binary")


def tokens_of_prefix(changes: Column | str, characters: Column | str) -> Column:
    """How many tokens the first so many code points have; the whole text's where it is shorter."""

    @F.pandas_udf("long")
    def count(raw: pd.Series, n: pd.Series) -> pd.Series:
        some = (np.frombuffer(x, dtype=np.int8, count=min(max(int(k), 0), len(x))) for x, k in zip(raw, n, strict=True))
        return pd.Series([int(x.sum(dtype=np.int64)) for x in some], dtype="int64")

    return count(changes, characters)


def characters_within(changes: Column | str, budget: Column | str) -> Column:
    """Code points of the longest prefix with at most so many tokens.

    More text may have fewer tokens, so it is the last place within the budget, not the one before the first beyond it.
    """

    @F.pandas_udf("long")
    def longest(raw: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(raw, most, strict=True):
            counts = np.cumsum(np.frombuffer(x, dtype=np.int8), dtype=np.int64)
            inside = np.flatnonzero(counts <= k)
            out.append(int(inside[-1]) + 1 if len(inside) else 0)
        return pd.Series(out, dtype="int64")

    return longest(changes, budget)


def token_counts(prefixes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (code points of the longest prefix within the limit) from stored prefixes."""
    fit = characters_within("changes", F.lit(limit))
    return prefixes.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), fit.alias("fit_chars"))
