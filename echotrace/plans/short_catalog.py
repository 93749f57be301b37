"""Queries of the matching kernels on short pairs, which SQL can work out by trying all windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.functions import sequences as S
from echotrace.operators import matching as M
from echotrace.operators import prepare as P
from echotrace.operators import results as R
from echotrace.plans.catalog import PAIR, PAIRS_SQL, pairs, query, r6, table

#: First letters of twelve words, and the same with two swapped, one missing or one replaced, or those of the next turn.
SHORT_SQL = f"""{PAIRS_SQL},
    letters AS (SELECT conv_id, turn, role, (conv_id + turn) % 4 AS k, list_transform(a[1:12], lambda x: left(x, 1)) AS x, list_transform(b[1:12], lambda x: left(x, 1)) AS y FROM p WHERE len(a) >= 12),
    s AS (SELECT conv_id, turn, role, x AS a, CASE k WHEN 0 THEN x[1:4] || [x[6], x[5]] || x[7:12] WHEN 1 THEN x[1:5] || x[7:12] WHEN 2 THEN x[1:5] || ['Z'] || x[7:12] ELSE y END AS b FROM letters)"""


def short_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = lambda c: F.transform(F.slice(c, 1, 12), lambda x: F.substring(x, 1, 1))
    rows = pairs(spark, sf_dir).where(F.size("a") >= 12).select(*PAIR, "role", letters("a").alias("a"), letters("b").alias("y"))
    k, part, at = (F.col("conv_id") + F.col("turn")) % 4, lambda i, n: F.slice("a", i, n), lambda i: F.get("a", F.lit(i))
    other = F.when(k == 0, F.concat(part(1, 4), F.array(at(5), at(4)), part(7, 6))).when(k == 1, F.concat(part(1, 5), part(7, 6)))
    return rows.withColumn("b", other.when(k == 2, F.concat(part(1, 5), F.array(F.lit("Z")), part(7, 6))).otherwise(F.col("y"))).drop("y")


#: All windows of five elements or more that are at most one edit apart. One run on the main diagonal and an edit is no match.
WINDOWS_SQL = f"""{SHORT_SQL},
    w AS (SELECT DISTINCT conv_id, turn, i, least(i + n, len(a)) AS e, j, least(j + n, len(b)) AS f, a[i + 1:i + n] AS x, b[j + 1:j + n] AS y
        FROM (SELECT *, unnest(range(len(a) - 4)) AS i FROM s), range(12) r(j), range(5, 13) q(n) WHERE j <= len(b) - 5 AND n <= greatest(len(a), len(b))),
    c AS (SELECT *, list_filter(range(1, least(len(x), len(y)) + 1), lambda t: x[t] <> y[t]) AS d FROM w WHERE abs(len(x) - len(y)) <= 1),
    g AS (SELECT *, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda t: x[t] = y[t] AND (t = 1 OR x[t - 1] <> y[t - 1]))) AS runs,
        CASE WHEN len(x) = len(y) THEN CASE WHEN len(d) <= 1 THEN len(d) WHEN len(d) = 2 AND d[2] = d[1] + 1 AND x[d[1]] = y[d[2]] AND x[d[2]] = y[d[1]] THEN 1 END
            WHEN len(x) > len(y) THEN CASE WHEN x[1:coalesce(d[1], len(x)) - 1] || x[coalesce(d[1], len(x)) + 1:] = y THEN 1 END
            WHEN y[1:coalesce(d[1], len(y)) - 1] || y[coalesce(d[1], len(y)) + 1:] = x THEN 1 END AS edits FROM c),
    spans AS (SELECT conv_id, turn, greatest(e - i, f - j) AS length, edits, i AS start1, e AS end1, j AS start2, f AS end2 FROM g WHERE edits IS NOT NULL AND NOT (edits > 0 AND runs = 1))"""


@query(f"WITH {WINDOWS_SQL} SELECT conv_id, turn, edits, count(*) AS spans, CAST(sum(length) AS BIGINT) AS total, min(start1) AS first, max(end2) AS last FROM spans GROUP BY ALL")
def potential_matches_short(spark, sf_dir):
    found = M.relaxed_spans(short_pairs(spark, sf_dir), PAIR)
    return found.groupBy(*PAIR, "edits").agg(
        F.count("*").alias("spans"), F.sum("length").alias("total"), F.min("start1").alias("first"), F.max("end2").alias("last")
    )


@query(f"""WITH {WINDOWS_SQL} SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans t WHERE t.conv_id = s.conv_id AND t.turn = s.turn
        AND (t.length > s.length OR (t.length = s.length AND (t.start1, t.start2, t.end1, t.end2) < (s.start1, s.start2, s.end1, s.end2)))
        AND t.start1 <= s.start1 AND t.end1 >= s.end1 AND t.start2 <= s.start2 AND t.end2 >= s.end2 AND t.edits <= s.edits)""")
def relaxed_matches_short(spark, sf_dir):
    return M.relaxed_matches(short_pairs(spark, sf_dir), PAIR).drop("tokens1", "tokens2")


#: Common runs with all their beginnings, taken one after another where they meet none that was taken.
GREEDY_SQL = f"""{SHORT_SQL},
    hits AS (SELECT conv_id, turn, i, j FROM (SELECT *, unnest(range(len(a))) AS i FROM s), range(12) r(j) WHERE j < len(b) AND a[i + 1] = b[j + 1]),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS g FROM hits),
    longest AS (SELECT conv_id, turn, min(i) AS i, min(j) AS j, count(*) AS n FROM islands GROUP BY conv_id, turn, i - j, g),
    beginnings AS (SELECT conv_id, turn, m AS n, i, j FROM longest, range(2, 13) r(m) WHERE m <= n),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i + n, j + n) AS pos FROM beginnings),
    walk AS (
        SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(n BIGINT, i BIGINT, j BIGINT)[]) AS taken FROM s
        UNION ALL
        SELECT w.conv_id, w.turn, o.pos, CASE WHEN len(list_filter(taken, lambda t: t.i < o.i + o.n AND t.i + t.n > o.i AND t.j < o.j + o.n AND t.j + t.n > o.j)) = 0
            THEN taken || [{{'n': o.n, 'i': o.i, 'j': o.j}}] ELSE taken END
        FROM walk w JOIN ordered o ON o.conv_id = w.conv_id AND o.turn = w.turn AND o.pos = w.pos + 1),
    greedy AS (SELECT s.*, taken FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos DESC) = 1) JOIN s USING (conv_id, turn))"""


@query(f"""WITH RECURSIVE {GREEDY_SQL} SELECT conv_id, turn, r AS "rank", taken[r + 1].n AS length, taken[r + 1].i AS start1, taken[r + 1].i + taken[r + 1].n AS end1,
        taken[r + 1].j AS start2, taken[r + 1].j + taken[r + 1].n AS end2, array_to_string(a[taken[r + 1].i + 1:taken[r + 1].i + taken[r + 1].n], ' ') AS tokens
    FROM greedy, range(12) q(r) WHERE r < len(taken)""")
def all_common_substrings_short(spark, sf_dir):
    return M.all_common_substrings(short_pairs(spark, sf_dir), PAIR).withColumn("tokens", F.array_join("tokens", " "))


@query(f"""WITH RECURSIVE {GREEDY_SQL} SELECT conv_id, turn, array_to_string(list_transform(taken, lambda t: array_to_string(a[t.i + 1:t.i + t.n], ' ')), '|') AS shown FROM greedy""")
def match_values_short(spark, sf_dir):
    found = M.match_values(short_pairs(spark, sf_dir), PAIR)
    return found.select(*PAIR, F.array_join(F.transform("values", lambda v: F.array_join(v, " ")), "|").alias("shown"))


@query(f"""WITH RECURSIVE {GREEDY_SQL} SELECT role, round(avg(m), 6) AS mean_length, count(m) AS with_match, count(*) AS sequences
    FROM (SELECT role, list_avg(list_transform(taken, lambda t: t.n)) AS m FROM greedy) GROUP BY role""")
def mean_common_substring_length_short(spark, sf_dir):
    p = short_pairs(spark, sf_dir)
    found = R.macro_average(M.all_common_substrings(p, PAIR), p.select(*PAIR, "role"), PAIR, ["role"])
    return found.withColumn("mean_length", r6(F.col("mean_length")))


#: The table of longest common subsequences row by row, and the walk back through it.
BACK_SQL = f"""{SHORT_SQL},
    tables AS (SELECT conv_id, turn, 0 AS i, [list_transform(range(len(b) + 1), lambda j: 0)] AS t FROM s
        UNION ALL
        SELECT conv_id, turn, i + 1, t || [list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1),
            lambda q: CASE WHEN q > 0 AND b[q] = a[i + 1] THEN greatest(t[i + 1][q + 1], t[i + 1][q] + 1) ELSE t[i + 1][q + 1] END)))]
        FROM tables JOIN s USING (conv_id, turn) WHERE i < len(a)),
    back AS (SELECT conv_id, turn, len(a) AS i, len(b) AS j, t, CAST([] AS BIGINT[]) AS p1, CAST([] AS BIGINT[]) AS p2 FROM tables JOIN s USING (conv_id, turn) WHERE i = len(a)
        UNION ALL
        SELECT conv_id, turn, CASE WHEN same OR NOT left_ THEN i - 1 ELSE i END, CASE WHEN same OR left_ THEN j - 1 ELSE j END, t,
            CASE WHEN same THEN list_prepend(i - 1, p1) ELSE p1 END, CASE WHEN same THEN list_prepend(j - 1, p2) ELSE p2 END
        FROM (SELECT back.*, a[i] = b[j] AS same, a[i] <> b[j] AND t[i + 1][j] > t[i][j + 1] AS left_ FROM back JOIN s USING (conv_id, turn) WHERE i > 0 AND j > 0)),
    places AS (SELECT conv_id, turn, a, b, p1, p2 FROM back JOIN s USING (conv_id, turn) WHERE i = 0 OR j = 0)"""


@query(f"""WITH RECURSIVE {BACK_SQL} SELECT conv_id, turn, len(p1) AS n, array_to_string(list_transform(p1, lambda i: a[i + 1]), ' ') AS tokens,
        array_to_string(p1, ' ') AS positions1, array_to_string(p2, ' ') AS positions2,
        array_to_string(list_transform(range(len(b)), lambda j: CASE WHEN list_contains(p2, j) THEN '<mark>' || b[j + 1] || '</mark>' ELSE b[j + 1] END), ' ') AS marked FROM places""")
def contributing_tokens_short(spark, sf_dir):
    p = short_pairs(spark, sf_dir)
    found = M.contributing_tokens(p, PAIR).join(p.select(*PAIR, "b"), PAIR)
    found = found.withColumn("marked", S.highlighted(F.col("b"), F.col("positions2")))
    shown = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("tokens", "positions1", "positions2")]
    return found.select(*PAIR, "n", *shown, "marked")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), f AS (SELECT count(*) AS fixed FROM range((SELECT n FROM n)) r(x), n WHERE x IN (0, n - 1) OR x % 50 = 0)
    SELECT fixed, least(100, n - fixed) AS extra, CAST(0 AS BIGINT) AS outside, least(100, n - fixed) + fixed AS "distinct" FROM n, f""")
def sampled_index_rules(spark, sf_dir):
    """The sample by its rules: all fixed ones, a hundred others, none outside, each once."""
    total = table(spark, sf_dir, "documents").count()
    fixed = F.col("index").isin(0, total - 1) | (F.col("index") % 50 == 0)
    return P.sampled_indices(spark, total, 50).agg(
        F.count_if(fixed).alias("fixed"),
        F.count_if(~fixed).alias("extra"),
        F.count_if((F.col("index") < 0) | (F.col("index") >= total)).alias("outside"),
        F.count_distinct("index").alias("distinct"),
    )

