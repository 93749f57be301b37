"""Longest matches against a corpus, by comparing every text with every document."""

import random

from echotrace.operators import corpus


def longest(text, docs, least):
    best = None
    for n in range(len(text), least - 1, -1):
        for i in range(len(text) - n + 1):
            places = [(d, j) for d, t in docs for j in range(len(t) - n + 1) if t[j : j + n] == text[i : i + n]]
            if places:
                d, j = min(places)
                return (n, i, i + n, d, j, j + n, len(places))
    return best or (None,) * 7


def test_longest_match_of_each_text(spark):
    rnd = random.Random(1)
    docs = [(d, [rnd.choice("abcd") for _ in range(rnd.randint(0, 60))]) for d in range(30)]
    docs += [(100 + d, docs[3][1]) for d in range(20)] + [(200, ["x"] * 300), (201, None)]
    texts = [(i, [rnd.choice("abcde") for _ in range(rnd.randint(0, 25))]) for i in range(30)]
    texts += [(50, docs[3][1] + ["z"]), (51, ["z", *docs[3][1], "z", *docs[3][1]]), (52, ["x"] * 299), (53, None), (54, ["nowhere"] * 5), (55, docs[5][1])]
    left = spark.createDataFrame(texts, "id long, t array<string>").repartition(3)
    right = spark.createDataFrame(docs, "doc long, words array<string>").repartition(4)
    for least in (2, 3):
        got = corpus.longest_in_corpus(left, "id", "t", right, "doc", "words", least).collect()
        known = [(d, t or []) for d, t in docs]
        assert sorted(map(tuple, got)) == sorted((i, *longest(t or [], known, least)) for i, t in texts)


def test_no_corpus_and_no_texts(spark):
    left = spark.createDataFrame([(1, ["a", "b"])], "id long, t array<string>")
    none = spark.createDataFrame([], "doc long, words array<string>")
    assert [tuple(r) for r in corpus.longest_in_corpus(left, "id", "t", none, "doc", "words").collect()] == [(1, *(None,) * 7)]
    assert corpus.longest_in_corpus(left.limit(0), "id", "t", none, "doc", "words").count() == 0


def test_places_of_short_windows_are_not_carried_on(spark, monkeypatch):
    """Every pair of tokens of the corpus stands in the texts, but their longest runs have five tokens and more: few places are written."""
    rnd = random.Random(3)
    docs = [(d, [rnd.choice("abcde") for _ in range(100)]) for d in range(40)]
    texts = [(i, [rnd.choice("abcde") for _ in range(30)]) for i in range(4)]
    written, stored = [], corpus.stored

    def counted(df, tag, path=None):
        out = stored(df, tag, path)
        written.append(out.count())
        return out

    monkeypatch.setattr(corpus, "stored", counted)
    left = spark.createDataFrame(texts, "id long, t array<string>")
    right = spark.createDataFrame(docs, "doc long, words array<string>")
    got = corpus.longest_in_corpus(left, "id", "t", right, "doc", "words").collect()
    assert sorted(map(tuple, got)) == sorted((i, *longest(t, docs, 2)) for i, t in texts)
    assert max(written) < 40 * 99 / 4
