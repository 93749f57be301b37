"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

Kernel of two words: K(s, u) sums over all common subsequences of ORDER letters DECAY to the power of the letters left out between
the matched ones, in both strings, divided by the square root of K(s, s) K(u, u), to the power POWER. So an insult still
matches with letters inserted or dropped, by as much less as the gaps are long. A word is reduced to its letters,
lower-cased, with marks where it begins and ends; single letters that follow each other are joined ("m o r o n"), and a word of
over WINDOW letters has the largest values of windows that overlap by half. The kernel of two sentences is the sum over their
pairs of words, so two words that are harmless alone can be toxic together.

Landmarks: substrings of words in toxic documents, chosen one after another by the log-likelihood ratio of toxic and
clean documents with them, each counted over the words that none before it explains, as long as the ratio is larger than
chance gives among so many words (twice the logarithm of their number) or than half of the best one's, whichever is
less, so few labels give landmarks too; and the clean words that come closest to being toxic. The map K_LL^-1/2
K_L(s) makes a linear machine of the kernel machine.

Learnt from sentences: all sentences of clean documents are negative. A label says that some sentence of a toxic document is toxic, so
learning alternates: in each toxic document the sentence with the largest decision value, and any other with a positive one,
are its toxic sentences, and the machine is fitted again. A word's evidence counts from FLOOR of a typical insult's on, and a
sentence's value is the sum of its words'. A document's score is a logistic function of its strongest sentence, the sum of its
three strongest and its length, fitted on the documents at their true ratio.

Learnt from TOXIC and CLEAN distinct labelled texts at most, those with the smallest hashes; every sentence and word of them is used.

Defined results: null and empty text, or a text without letters, has the score of a text with no match at all; a null label is
never learnt from; several labels of one document count as toxic if one is; without labels of both kinds every score is 0; repeated rows
return repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.llm._common import broadcast_if_small, held_out, process_cache, smallest_hashes, stored
from echotrace.llm._svm import fit_linear
from echotrace.llm._tokens import groups

#: Distinct labelled texts that are learnt from, at most.
TOXIC, CLEAN = 500, 1000
ORDER, DECAY, POWER, WINDOW = 3, 0.6, 3, 18
#: Letters of a landmark, and landmarks at most: toxic ones (there are fewer unless so many pass the test), clean ones.
GRAM, LANDMARKS, CONTRASTS = (5, 9), 64, 8
#: A landmark isn't taken if so many before it are so similar (before POWER).
ALIKE, ALIKE_MOST = 0.6, 2
#: Share of a typical insult's evidence that a word needs to count.
FLOOR = 0.3
THRESHOLD = 0.3
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_WORDS = 400_000


def joined_letters(words: list[str]) -> list[str]:
    """The words, with runs of single letters as one word."""
    if min(map(len, words), default=2) > 1:
        return words
    out, run = [], ""
    for w in words:
        if len(w) == 1:
            run += w
        else:
            if run:
                out.append(run)
                run = ""
            out.append(w)
    if run:
        out.append(run)
    return out


def letters(word: str) -> str:
    return word if word.isalpha() else _NOT_LETTERS.sub("", word)


def ends_sentence(word: str) -> bool:
    return word[-1] in ".!?"


def sentences_of(text: str | None) -> list[list[str]]:
    """The words of each sentence as written; sentences end with a line and behind . ! ?"""
    out = []
    for line in (text or "").lower().split("\n"):
        sentence: list[str] = []
        for w in joined_letters(line.split()):
            sentence.append(w)
            if ends_sentence(w):
                out.append(sentence)
                sentence = []
        if sentence:
            out.append(sentence)
    return out


def windows(word: str) -> list[str]:
    """The kernel's strings of a word: marked where it begins and ends, and cut if it is long."""
    word = f"^{word}$"
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def _reach(m: int) -> np.ndarray:
    """Weights of going on from one letter to a later one."""
    step = np.arange(m)
    gap = step[None, :] - step[:, None] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)


class Kernel:
    """K(s, u) of many strings s with fixed landmarks u."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.m = landmarks, max(map(len, landmarks), default=1)
        alphabet = sorted(set("".join(landmarks)))
        self.code = {ord(c): i + 1 for i, c in enumerate(alphabet)}
        self.match = np.zeros((len(alphabet) + 1, len(landmarks), self.m), dtype=np.float32)
        for j, u in enumerate(landmarks):
            for k, c in enumerate(u):
                self.match[self.code[ord(c)], j, k] = 1
        self.reach = _reach(self.m)
        self.codes = np.zeros(max(self.code, default=0) + 2, dtype=np.int64)
        for point, code in self.code.items():
            self.codes[point] = code
        points = [np.array([[ord(c) for c in u]]) for u in landmarks]
        self.scale = np.sqrt(np.array([max(self._own(x)[0], 1e-9) for x in points], dtype=np.float32))

    def __call__(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.landmarks)), dtype=np.float32)
        by_length = defaultdict(list)
        for i, s in enumerate(strings):
            if len(s) >= ORDER:
                by_length[len(s)].append(i)
        for n, rows in by_length.items():
            for at in range(0, len(rows), 64):
                part = np.array(rows[at : at + 64])
                points = np.frombuffer(
                    "".join(strings[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32
                ).reshape(-1, n)
                codes = self.codes[np.minimum(points, len(self.codes) - 1)]
                useful = (codes > 0).sum(axis=1) >= ORDER
                if useful.any():
                    found = self._run(len(useful.nonzero()[0]), n, lambda t, c=codes[useful]: self.match[c[:, t]], self.reach)
                    out[part[useful]] = found / np.sqrt(self._own(points[useful]))[:, None] / self.scale
        return out

    def _run(self, b: int, n: int, match_at, reach: np.ndarray) -> np.ndarray:
        """The recurrence over the n letters of b strings; match_at(t): which letters of the other side equal letter t."""
        shape = match_at(0).shape
        # ahead[i]: weights of subsequences of i+1 letters that end before this letter of s, by where they end in u.
        ahead = [np.zeros(shape, dtype=np.float32) for _ in range(ORDER - 1)]
        total = np.zeros(shape, dtype=np.float32)
        for t in range(n):
            ends = match = match_at(t)
            for i in range(ORDER - 1):
                longer = match * (ahead[i].reshape(-1, shape[-1]) @ reach).reshape(shape)
                ahead[i] *= np.float32(DECAY)
                ahead[i] += ends
                ends = longer
            total += ends
        return total.sum(axis=-1)

    def _own(self, points: np.ndarray) -> np.ndarray:
        """K(s, s) of strings of one length."""
        b, n = points.shape
        return self._run(b, n, lambda t: (points == points[:, t : t + 1]).astype(np.float32), _reach(n))


class WordKernel:
    """The kernel's values of words (reduced to letters) with the landmarks."""

    def __init__(self, landmarks: list[str]):
        self.kernel, self.n = Kernel(landmarks), len(landmarks)

    def __call__(self, words: list[str]) -> np.ndarray:
        out, parts, owner = np.zeros((len(words), self.n), dtype=np.float32), [], []
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                found = windows(w)
                parts += found
                owner += [i] * len(found)
        if parts:
            np.maximum.at(out, np.array(owner), self.kernel(parts))
        return out**POWER


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray  # of the kernel with each landmark
    floor: float
    logistic: np.ndarray  # of the strongest sentence, the three strongest, the logarithm of the number of words, and 1

    def counted(self, evidence: np.ndarray) -> np.ndarray:
        return np.where(evidence >= self.floor, evidence, 0).astype(np.float32)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[:3] + self.logistic[3], -40, 40)))


def document_features(value: np.ndarray, opens: np.ndarray, owner: np.ndarray, n_documents: int) -> np.ndarray:
    """The three features of each document, from the value of each word, whether a sentence begins with it, and its document."""
    out = np.zeros((n_documents, 3))
    if len(value):
        starts = np.flatnonzero(opens)
        sums, of = np.add.reduceat(value.astype(np.float64), starts), owner[starts]
        order = np.lexsort((-sums, of))
        sums, of = sums[order], of[order]
        first = np.searchsorted(of, of)
        rank = np.arange(len(of)) - first
        out[of[rank == 0], 0] = sums[rank == 0]
        out[:, 1] = np.bincount(of[rank < 3], sums[rank < 3], n_documents)
        out[:, 2] = np.log1p(np.bincount(owner, minlength=n_documents))
    return out


class Scorer:
    """Probabilities of texts; each distinct word is worked out once, and the most frequent are kept."""

    def __init__(self, model: ToxicityModel):
        self.model, self.kernel = model, WordKernel(model.landmarks)
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.value, self.seen, self.ends = np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def of_words(self, words: list[str]) -> np.ndarray:
        plain = [letters(w) for w in words]
        distinct = list(dict.fromkeys(plain))
        place = {w: i for i, w in enumerate(distinct)}
        values = self.model.counted(self.kernel(distinct) @ self.model.weights)
        return values[[place[w] for w in plain]]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        words, lines, lens = [], [], []
        for text in texts:
            before = len(words)
            for line in (text or "").lower().split("\n"):
                lines.append(len(words))
                words += joined_letters(line.split())
            lens.append(len(words) - before)
        at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        known, new = len(self.value), []
        for word in reversed(self.index):  # the newest come first
            if self.index[word] < known:
                break
            new.append(word)
        if new:
            new.reverse()
            self.value = np.concatenate([self.value, self.of_words(new)])
            self.ends = np.concatenate([self.ends, np.fromiter(map(ends_sentence, new), dtype=bool, count=len(new))])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), dtype=np.int64)])
        self.seen += np.bincount(at, minlength=len(self.seen))
        opens = np.zeros(len(words) + 1, dtype=bool)
        opens[lines] = True
        opens[1:] |= self.ends[at]
        features = document_features(self.value[at], opens[:-1], np.repeat(np.arange(len(texts)), lens), len(texts))
        if len(self.index) > _WORDS:
            self._forget()
        return self.model.probability(features)

    def _forget(self) -> None:
        order = np.argsort(-self.seen, kind="stable")[: _WORDS // 2]
        words = list(self.index)
        self.index = defaultdict(count(len(order)).__next__, {words[i]: k for k, i in enumerate(order.tolist())})
        self.value, self.ends, self.seen = self.value[order], self.ends[order], self.seen[order] // 2


def _grams(words: Iterable[str]) -> set[str]:
    lo, hi = GRAM
    return {w[i : i + n] for w in words for n in range(lo, hi + 1) for i in range(len(w) - n + 1)}


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = LANDMARKS) -> list[str]:
    """Substrings of words by their log-likelihood ratio, each counted over the words that none before it explains. toxic, clean: the words of each document."""
    in_toxic: dict[str, list[int]] = defaultdict(list)
    for i, words in enumerate(toxic):
        for w in words:
            in_toxic[w].append(i)
    in_clean: dict[str, list[int]] = defaultdict(list)
    for i, words in enumerate(clean):
        for w in words:
            in_clean[w].append(i)
    odds = len(toxic) / max(1, len(clean))
    parts: dict[str, list[str]] = defaultdict(list)
    for w, docs in in_toxic.items():
        if len(docs) > odds * len(in_clean.get(w, ())):
            for g in _grams([w]):
                parts[g].append(w)
    usual: dict[str, set[int]] = defaultdict(set)
    for w, docs in in_clean.items():
        for g in _grams([w]) & parts.keys():
            usual[g].update(docs)

    def ratio(g: str) -> float:
        k, c = len({i for w in parts[g] for i in in_toxic[w]}), len(usual[g])
        share, expected = k / max(1, k + c), odds / (1 + odds)
        if share <= expected or k < min(2, len(toxic)):
            return 0.0
        return 2 * (k * np.log(share / expected) + (c * np.log((1 - share) / (1 - expected)) if c else 0))

    worth = {g: x for g in list(parts) if (x := ratio(g)) > 0}
    least = min(2 * np.log(2 + len(in_toxic)), max(worth.values(), default=0.0) / 2)
    worth = {g: x for g, x in worth.items() if x >= least}
    chosen: list[str] = []
    while worth and len(chosen) < most:
        best = max(worth, key=lambda g: (round(worth[g], 6), len(g), g))
        if chosen and (Kernel([best])(chosen) > ALIKE).sum() >= ALIKE_MOST:
            del worth[best]
            continue
        chosen.append(best)
        explained, touched = set(parts[best]), set()
        for w in explained:
            touched |= _grams([w]) & worth.keys()
        for g in touched:
            parts[g] = [w for w in parts[g] if w not in explained]
            if (x := ratio(g)) >= least:
                worth[g] = x
            else:
                del worth[g]
        worth.pop(best, None)
    return sorted(chosen)


class _Sentences:
    """The sentences of documents as places of distinct words, one after another."""

    def __init__(self, docs: list[list[list[str]]], place: dict[str, int]):
        sizes = [len(s) for d in docs for s in d]
        self.n, self.words = len(docs), np.array([place[w] for d in docs for s in d for w in s], dtype=np.int64)
        self.starts = np.cumsum([0, *sizes])[:-1].astype(np.int64)
        self.of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.owner = np.repeat(self.of, sizes)
        self.opens = np.zeros(len(self.words), dtype=bool)
        self.opens[self.starts] = True

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of rows of values over each sentence."""
        return np.add.reduceat(values[self.words], self.starts, axis=0) if len(self.starts) else np.zeros(
            (0, *values.shape[1:]), dtype=np.float32
        )

    def strongest(self, value: np.ndarray) -> np.ndarray:
        """The sentence with the largest value of each document that has one."""
        order = np.lexsort((-value, self.of))
        return order[np.unique(self.of[order], return_index=True)[1]]


def fit(toxic: list[list[list[str]]], clean: list[list[list[str]]], weight_toxic: float = 1.0, weight_clean: float = 1.0) -> ToxicityModel:
    """toxic, clean: the words of each sentence of each labelled document. Weights: how many documents each one stands for."""
    docs = [[[w for w in map(letters, s) if w] for s in d] for d in (*toxic, *clean)]
    docs = [[s for s in d if s] for d in docs]
    toxic, clean = docs[: len(toxic)], docs[len(toxic) :]
    bags = [[{p for s in d for w in s for p in windows(w) if len(p) > ORDER + 1} for d in side] for side in (toxic, clean)]
    marks = choose_landmarks(*bags)
    if not marks:
        return ToxicityModel([], np.zeros(0, dtype=np.float32), 0.0, np.array([0.0, 0.0, 0.0, -40.0]))
    words = sorted({w for d in docs for s in d for w in s})
    place = {w: i for i, w in enumerate(words)}
    positive, negative = _Sentences(toxic, place), _Sentences(clean, place)
    values = WordKernel(marks)(words)
    witness = positive.strongest(positive.sums(values.max(axis=1)))
    for turn in range(2):
        k_ll = values_of_landmarks(marks)
        eigen, vectors = np.linalg.eigh((k_ll + k_ll.T) / 2)
        to_features = (vectors / np.sqrt(np.maximum(eigen, 1e-3 * eigen.max()))) @ vectors.T
        x_pos, x_neg = (side.sums(values) @ to_features for side in (positive, negative))
        # Sentences with no likeness to a landmark count less than the others together.
        near = np.abs(x_neg).sum(axis=1) > 0.05 * np.abs(x_pos[witness]).sum(axis=1).mean()
        w_neg = np.where(near, 1.0 / max(1, near.sum()), 0.2 / max(1, (~near).sum()))
        for _ in range(3):
            n_of = np.bincount(positive.of[witness], minlength=positive.n)
            w_pos = 1.0 / (n_of[positive.of[witness]] * (n_of > 0).sum())
            x = np.concatenate([x_pos[witness], x_neg]).astype(np.float32)
            y = np.concatenate([np.ones(len(witness)), -np.ones(len(x_neg))])
            w = fit_linear(x, y, penalty=1e-4, rounds=400, weight=np.concatenate([w_pos, w_neg]))
            decision = x_pos @ w[:-1] + w[-1]
            witness = np.union1d(positive.strongest(decision), np.flatnonzero(decision > 0))
        weights = (to_features @ w[:-1]).astype(np.float32)
        if turn == 0:
            evidence = values @ weights
            seen = np.bincount(negative.words, minlength=len(words))
            closest = np.argsort(-evidence * np.log1p(seen), kind="stable")[:CONTRASTS]
            more = [p for i in closest if seen[i] and evidence[i] > 0 for p in windows(words[i])[:1]]
            marks = list(dict.fromkeys([*marks, *more]))
            values = WordKernel(marks)(words)
    evidence = values @ weights
    typical = np.median(np.maximum.reduceat(evidence[positive.words], positive.starts)[positive.strongest(decision)])
    model = ToxicityModel(marks, weights, float(FLOOR * max(typical, 1e-6)), np.zeros(4))
    value = model.counted(evidence)
    features = [document_features(value[side.words], side.opens, side.owner, side.n) for side in (positive, negative)]
    labels = np.concatenate([np.ones(positive.n), np.zeros(negative.n)])
    model.logistic = _logistic(np.concatenate(features), labels, np.where(labels == 1, weight_toxic, weight_clean))
    return model


def values_of_landmarks(marks: list[str]) -> np.ndarray:
    return Kernel(marks)(marks).astype(np.float64) ** POWER


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of the columns and a constant, by Newton's method with smoothed targets."""
    weight = weight * len(y) / weight.sum()
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.column_stack([x, np.ones(len(x))])
    scale = np.maximum(np.abs(z).max(axis=0), 1e-9)
    z, c = z / scale, np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        grad = z.T @ (weight * (p - t)) + 1e-2 * c
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(c))
        move = np.linalg.solve(hess, grad)
        c = c - move * min(1, 3 / (np.abs(move).max() + 1e-9))
    return c / scale


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _sentences(text: pd.Series) -> pd.Series:
    """Sentences of distinct words; a sentence that stands again in its text says nothing new."""
    return pd.Series([[list(s) for s in dict.fromkeys(tuple(dict.fromkeys(s)) for s in sentences_of(t))] for t in text])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = TOXIC,
    clean: int = CLEAN,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """docs: only rows that may be learnt from."""
    label = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        "doc_id is not null and y is not null"
    ).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # Keys and hashes are joined with the labels; texts are read again for the chosen rows only and never shuffled.
    keys = texts.select("doc_id", F.xxhash64("text").alias("h")).join(label, "doc_id").groupBy("h").agg(
        F.max("y").alias("y"), F.min("doc_id").alias("doc_id")
    )
    keys = stored(keys, "labelled")  # a row for each distinct text
    counts = {r["y"]: r["count"] for r in keys.groupBy("y").count().collect()}  # two rows
    few = smallest_hashes(keys, "y", F.when(F.col("y") == 1, toxic).otherwise(clean))
    chosen = broadcast_if_small(stored(few.join(keys, ["y", "h"]), "chosen"))
    sample = texts.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"]).groupBy("h", "y").agg(F.min("text").alias("text"))
    found = sorted(
        (r["y"], r["h"], r["s"]) for r in sample.select("y", "h", _sentences("text").alias("s")).collect()
    )  # toxic + clean rows at most
    parts = [[s for y, _, s in found if y == k] for k in (1, 0)]
    if not all(parts):
        return ToxicityModel([], np.zeros(0, dtype=np.float32), 0.0, np.array([0.0, 0.0, 0.0, -40.0]))
    return fit(*parts, counts[1] / len(parts[0]), counts[0] / len(parts[1]))


def scored(model: ToxicityModel, text: Column) -> Column:
    key = repr((model.landmarks, model.weights.tobytes(), model.floor, model.logistic.tobytes()))

    def score(texts: pd.Series) -> pd.Series:
        if not model.landmarks:
            return pd.Series(np.zeros(len(texts)))
        cache = process_cache("toxicity")
        if key not in cache:
            cache.clear()
            cache[key] = Scorer(model)
        all_texts, out = texts.tolist(), [np.zeros(0)]
        for a, b in groups(all_texts):
            out.append(cache[key](all_texts[a:b]))
        return pd.Series(np.concatenate(out))

    return F.pandas_udf(score, "double")(text)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    model: ToxicityModel | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    model = model or learn(docs.where(~held_out(id_col)), labels, id_col=id_col, text_col=text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scored(model, F.col(text_col).cast("string")).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
