"""Quantiles by selection, containment by a sweep, and kernels at lengths that tables don't reach."""

import math
import random
import time

import numpy as np
import pytest

from echotrace.functions import kernels as K
from echotrace.operators import matching, results


def test_quantiles_of_cells_and_columns(spark, monkeypatch):
    rnd = random.Random(1)
    draws = [lambda: rnd.gauss(0, 1), lambda: rnd.choice([0.0, -0.0, 1.5]), lambda: 2.0 ** rnd.randint(-1070, 1020), lambda: rnd.choice([None, math.nan, 3.0]), lambda: float(rnd.randint(0, 10**15))]
    rows = [(c if c else None, draws[c % 5](), draws[(c + 1) % 5]()) for c in range(10) for _ in range(rnd.randint(1, 60))]
    rows += [(77, None, 1.0), (78, 1.7e308, -1.7e308), (78, -1.7e308, 1.7e308), (78, 5e-324, 1e-323), (78, 0.0, 5e-324)]
    df = spark.createDataFrame(rows, "c int, x double, y double").repartition(5)
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    for most in (1 << 17, 64):  # with few parts there are more passes
        monkeypatch.setattr(results, "_COUNTS", most)
        monkeypatch.setattr(results, "_PARTS", (2, 64))
        got = {(r["c"], r["column"]): (r["n"], list(r["quantiles"])) for r in results.cell_quantiles(df, ["c"], ["x", "y"], shares).collect()}
        want = {}
        for c in {r[0] for r in rows}:
            for i, name in ((1, "x"), (2, "y")):
                known = sorted(r[i] for r in rows if r[0] == c and r[i] is not None and not math.isnan(r[i]))
                if known:
                    at = [s * (len(known) - 1) for s in shares]
                    low, high = ([known[min(int(p) + d, len(known) - 1)] for p in at] for d in (0, 1))
                    want[c, name] = (len(known), [a + (b - a) * (p - int(p)) for a, b, p in zip(low, high, at, strict=True)])
        assert got.keys() == want.keys()
        for key, (n, q) in want.items():
            assert got[key][0] == n and got[key][1] == pytest.approx(q, rel=1e-12), key
    assert results.exact_quantiles(df, ["x", "y"], [0.5]).keys() == {"x", "y"}
    assert results.cell_quantiles(df.limit(0), ["c"], ["x"], [0.5]).count() == 0


def test_infinite_values_count_as_the_largest(spark):
    df = spark.createDataFrame([(math.inf,), (-math.inf,), (1.0,)], "v double")
    assert results.exact_quantiles(df, "v", [0.0, 0.5, 1.0]) == [-1.7976931348623157e308, 1.0, 1.7976931348623157e308]


def test_no_sort_of_values(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v")
    results.exact_quantiles(df, "v", [0.5])
    plan = results.cell_quantiles(df, [], ["v"], [0.5])._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def covered(spans):
    """Spans (length, edits, start1, end1, start2, end2, order) that one before them contains, by comparing all."""
    inside = lambda s, t: s[2] >= t[2] and s[3] <= t[3] and s[4] >= t[4] and s[5] <= t[5] and s[1] >= t[1]
    before = lambda s, t: (-t[0], t[6]) < (-s[0], s[6])
    return {s for s in spans if any(inside(s, t) and before(s, t) for t in spans)}


@pytest.mark.parametrize("width", [3, 50, 4096])
def test_containment_inside_keys(spark, width):
    rnd, rows = random.Random(width), []
    for key in [None, "a", "b"]:
        spans = []
        for order in range(150):
            i, j, n, m = rnd.randrange(40), rnd.randrange(40), rnd.randint(0, 25), rnd.randint(0, 25)
            spans.append((max(n, m), rnd.randrange(3), i, i + n, j, j + m, order))
        gone = covered(spans)
        rows += [(key, *s, s not in gone) for s in spans]
    df = spark.createDataFrame(rows, "k string, length int, edits int, start1 int, end1 int, start2 int, end2 int, ord long, stays boolean")
    got = matching.drop_contained(df.repartition(3), ["k"], "ord", width)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if r[-1])


def test_very_many_spans_in_one_key(spark):
    rnd, rows = random.Random(5), []
    for order in range(100_000):
        i, n = rnd.randrange(200_000), rnd.randint(3, 60)
        j = i + rnd.randrange(50)
        rows.append((1, n, rnd.randrange(3), i, i + n, j, j + n, order))
    df = spark.createDataFrame(rows, "k int, length int, edits int, start1 int, end1 int, start2 int, end2 int, ord long")
    got = {tuple(r)[1:7] for r in matching.drop_contained(df, ["k"], "ord").collect()}
    want = set(K.uncontained([r[1:7] for r in rows]))
    assert got == want and 0 < len(got) < len(rows)


def test_subsequences_by_words_of_bits():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        m, n, letters = rnd.integers(0, 150), rnd.integers(0, 150), rnd.integers(1, 30)
        a, b = rnd.integers(0, letters, m), rnd.integers(0, letters, n)
        table = K.lcs_table(a, b)
        assert K.lcs_length(a, b) == table[-1, -1]
        want, i, j = [], m, n
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                want.append((i, j))
            elif table[i, j - 1] > table[i - 1, j]:
                j -= 1
            else:
                i -= 1
        assert K.lcs_positions(a, b) == want[::-1]


def test_longest_windows_are_those_that_none_contains():
    rnd = np.random.default_rng(3)
    for _ in range(150):
        a = rnd.integers(0, rnd.integers(2, 7), rnd.integers(0, 40))
        b = np.insert(a, rnd.integers(0, len(a) + 1), 9) if rnd.random() < 0.6 else rnd.integers(0, 4, rnd.integers(0, 40))
        c, k = int(rnd.integers(1, 4)), int(rnd.integers(0, 4))
        assert K.relaxed_longest(a, b, c, k) == K.uncontained(K.relaxed_spans(a, b, c, k))


def test_starts_are_looked_for_in_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 5, 300), rnd.integers(0, 5, 200)
    whole = K.relaxed_starts(a, b, 6, 2)
    for most in (1, 40, 1000):
        monkeypatch.setattr(K, "_SEEDS", most)
        assert np.array_equal(K.relaxed_starts(a, b, 6, 2), whole)


def test_greedy_choice_does_not_depend_on_what_is_held(monkeypatch):
    rnd = np.random.default_rng(6)
    for _ in range(40):
        a, b = rnd.integers(0, rnd.integers(1, 5), rnd.integers(0, 60)), rnd.integers(0, 3, rnd.integers(0, 60))
        whole = K.disjoint_matches(a, b, 1)
        monkeypatch.setattr(K, "_RUNS", int(rnd.integers(1, 30)))
        monkeypatch.setattr(K.Squares.__init__, "__defaults__", (int(rnd.integers(1, 9)),))
        assert K.disjoint_matches(a, b, 1) == whole
        monkeypatch.undo()


def test_long_pairs_in_seconds():
    rnd = np.random.default_rng(7)
    a = rnd.integers(0, 3000, 2000)
    b = a.copy()
    b[rnd.integers(0, 2000, 40)] = 9999
    began = time.time()
    assert K.relaxed_longest(a, b, 3, 1)[0][0] > 50
    x, y = rnd.integers(0, 20_000, 20_000), rnd.integers(0, 20_000, 20_000)
    y[100:700] = x[5000:5600]
    assert K.disjoint_matches(x, y)[0] == (600, 5000, 5600, 100, 700) and K.lcs_length(x, y) >= 600
    assert time.time() - began < 60
