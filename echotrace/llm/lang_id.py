"""Hierarchical language identification.

Texts become hashed byte-trigram vectors. One-versus-rest linear support vector machines predict the language
family first; inside the family, one-versus-one machines for each pair of its languages vote, ties going to the larger
sum of margins. The score is the family's share times the mean pairwise share of the winner, each a logistic function
of margins.

Learnt from PER_LANGUAGE distinct labelled texts of each language, or all if there are fewer: those with the smallest hashes, so
the choice is the same at any partitioning, copies count once and no language is left out. The driver gets one vector
for each. Languages without a known family form one of their own.

Defined results: null text, or a text without a letter, is 'und' with score 0; a null language is never learnt from; if no label
is there all texts are 'und'; repeated rows return repeated rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm._common import broadcast_if_small, held_out, smallest_hashes, stored
from echotrace.llm._svm import fit_linear
from echotrace.llm._text_vectors import unit_vector

PER_LANGUAGE = 800
#: Texts whose vectors are multiplied at a time.
_BATCH = 256
UNDETERMINED = "und"
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi".split(),
    "romance": "fr es pt it ro ca gl oc rm".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga gd cy br".split(),
    "turkic": "tr az uz kk ky tk".split(),
    "indo-aryan": "hi ur bn pa gu mr ne si".split(),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@dataclass
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray  # a row for each family
    pairs: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        langs, scores = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        told = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not self.families or not told.any():
            return langs, scores
        x = np.stack([np.append(unit_vector(texts[i]), np.float32(1)) for i in np.flatnonzero(told)])
        margins = x @ self.family_weights.T
        family = margins.argmax(axis=1)
        score = 1 / np.exp(4 * (margins - margins.max(axis=1, keepdims=True))).sum(axis=1)
        found = np.empty(len(x), dtype=object)
        for f, name in enumerate(self.families):
            of = np.flatnonzero(family == f)
            members, pairs = self.members[name], self.pairs[name]
            if not pairs:
                found[of] = members[0]
                continue
            votes, total, shares = (np.zeros((len(of), len(members))) for _ in range(3))
            for (a, b), m in zip(pairs, (x[of] @ self.pair_weights[name].T).T, strict=True):
                votes[np.arange(len(of)), np.where(m >= 0, a, b)] += 1
                p = 1 / (1 + np.exp(-4 * m))
                for lang, margin, share in ((a, m, p), (b, -m, 1 - p)):
                    total[:, lang] += margin
                    shares[:, lang] += share
            best = np.where(votes == votes.max(axis=1, keepdims=True), total, -np.inf).argmax(axis=1)
            found[of] = np.array(members, dtype=object)[best]
            score[of] *= shares[np.arange(len(of)), best] / (len(members) - 1)
        langs[told], scores[told] = found, score
        return langs, scores


def fit(vectors: np.ndarray, langs: list[str]) -> LanguageModel:
    known = sorted(set(langs))
    family = {lang: _FAMILY_OF.get(lang, lang) for lang in known}
    families = sorted(set(family.values()))
    members = {f: [x for x in known if family[x] == f] for f in families}
    y, width = np.array(langs), vectors.shape[1] + 1
    of = np.array([family[x] for x in langs])
    model = LanguageModel(families, members, np.zeros((len(families), width), dtype=np.float32))
    if len(families) > 1:
        model.family_weights = np.stack([fit_linear(vectors, np.where(of == f, 1, -1)) for f in families])
    for f in families:
        model.pairs[f] = list(combinations(range(len(members[f])), 2))
        rows = []
        for a, b in model.pairs[f]:
            part = np.isin(y, [members[f][a], members[f][b]])
            rows.append(fit_linear(vectors[part], np.where(y[part] == members[f][a], 1, -1)))
        model.pair_weights[f] = np.stack(rows) if rows else np.zeros((0, width), dtype=np.float32)
    return model


@F.pandas_udf(T.BinaryType())
def _packed_vector(text: pd.Series) -> pd.Series:
    return pd.Series([unit_vector(t).astype(np.float16).tobytes() for t in text])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """docs: only rows that may be learnt from."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null"
    )
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = stored(smallest_hashes(rows, "lang", F.lit(per_language)), "language-sample")
    sample = rows.join(broadcast_if_small(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    found = sample.select("lang", _packed_vector("text").alias("v")).collect()  # per_language rows of each language at most
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    if not found:
        return LanguageModel([], {}, np.zeros((0, 1), dtype=np.float32))
    vectors = np.stack([np.frombuffer(bytes(r["v"]), dtype=np.float16) for r in found]).astype(np.float32)
    return fit(vectors, [r["lang"] for r in found])


def predicted(model: LanguageModel, text: Column) -> Column:
    """A struct of lang_pred and score."""

    def guess(texts: pd.Series) -> pd.DataFrame:
        whole = texts.tolist()
        parts = [model.predict(whole[i : i + _BATCH]) for i in range(0, len(whole), _BATCH)] or [model.predict([])]
        langs, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(guess, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learns from its own rows that aren't held out if no model is given."""
    model = model or learn(docs.where(~held_out(id_col)), text_col=text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predicted(model, F.col(text_col).cast("string")).alias("p")
    )
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
