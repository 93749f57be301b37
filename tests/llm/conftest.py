import random

import pytest

EXTRA = "key hash digest run fp count first n bucket shard c t w h place stay item size start value root node u v q p x y length lines all body spans".split()


def sentence(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, and columns whose names operators might use."""
    rnd = random.Random(5)
    words = [f"wort{i}" for i in range(300)]
    long = sentence(rnd, words, 20_000)
    base = [sentence(rnd, words, 60) for _ in range(12)]
    near = base[0].replace(base[0].split()[30], "changed")
    rows = [(i, t) for i, t in enumerate(base)] + [
        (20, base[0]),
        (21, base[0]),
        (21, base[0]),
        (22, near),
        (23, None),
        (24, ""),
        (25, " \n\t "),
        (26, "12 34 !!"),
        (27, long),
        (28, long + " end"),
    ]
    rows += [
        (None, "no id here at all"),
        (None, "no id here at all"),
        (None, None),
        (29, "Ünïcödé ẞ 日本語 \U0001f600 text"),
        (29, "the same id again with another text"),
    ]
    rows = [(i, t, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in EXTRA:
        df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    return [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
