"""The tidy score table (dimensions.., metric, score) and what is derived from it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from echotrace.functions.kernels import correlation_p_udf
from echotrace.functions.sequences import COMPARISONS, capitalised
from echotrace.sources.shared import broadcast_if_small, stored

DIMENSIONS = ["expr", "rep", "offset", "prefix", "suffix"]
STATISTICS = {"mean": F.avg, "std": F.stddev_pop, "max": F.max}


def tidy(df: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric of each row."""
    return df.unpivot(dimensions, metrics, "metric", "score")


def cell_statistics(scores: DataFrame, dimensions: list[str], mode: str = "all", score: str = "score") -> DataFrame:
    """mean, population std and max of each cell; mode: one of them, or all."""
    if mode != "all" and mode not in STATISTICS:
        raise ValueError(f"mode is all or one of {', '.join(STATISTICS)}, not {mode}")
    return scores.groupBy(*dimensions).agg(*(f(score).alias(name) for name, f in STATISTICS.items() if mode in ("all", name)))


def threshold_metrics(df: DataFrame, dimensions: list[str], metric: str, value: float, op: str, metrics: list[str]) -> DataFrame:
    """mean, sample std and count (of non-null values) of every metric over the rows that pass."""
    if op not in COMPARISONS:
        raise ValueError(f"op is one of {' '.join(COMPARISONS)}, not {op}")
    passed = df.where(COMPARISONS[op](F.col(metric), F.lit(value)))
    return passed.groupBy(*dimensions).agg(
        *(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count)))
    )


def cells_with_metric(scores: DataFrame, dimensions: list[str], metric: str) -> DataFrame:
    """Rows of the cells that have the metric; an error if none has."""
    cells = scores.where(F.col("metric") == metric).select(*dimensions).distinct()
    if cells.isEmpty():
        raise ValueError(f"no cell has {metric}")
    return scores.join(cells, dimensions, "left_semi")


#: Groups that one pass of a selection counts, about: ranks times parts of their interval. And the least and most parts.
_COUNTS, _PARTS = 1 << 17, (16, 4096)
_LARGEST = 1.7976931348623157e308


def _matches(left: str, right: str, names: list[str]) -> Column:
    """Equality of all names in two aliased tables, null equal to null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def _ranked_values(rows: DataFrame, cells: list[str], targets: DataFrame) -> DataFrame:
    """The k-th smallest value v (k from 0) of each target (cells, k, lo, hi, before) as lo.

    A target's value lies from lo to hi, and `before` rows of its cell lie below lo. Each pass cuts all intervals into equal parts,
    counts the rows of each part, and goes on in the part that holds the k-th row, from its least to its greatest value; an
    interval of one value is done. Only counts are shuffled, for all cells and ranks at once; no value is sorted.
    """
    names, targets = [*cells, "k"], stored(targets, "targets")
    while n := targets.where("lo < hi").count():
        parts = max(_PARTS[0], min(_PARTS[1], _COUNTS // n))
        open_ = targets.where("lo < hi").withColumnRenamed("before", "_before")
        inside = _matches("r", "t", cells) & F.col("v").between(F.col("lo"), F.col("hi"))
        hits = rows.alias("r").join(broadcast_if_small(open_).alias("t"), inside)
        # Halves, so that the width of no interval overflows; where halves are the same, the upper end is a part of its own.
        width = F.col("hi") / 2 - F.col("lo") / 2
        part = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * parts), F.lit(parts - 1))).otherwise(
            (F.col("v") > F.col("lo")).cast("long")
        )
        counts = hits.groupBy(*(F.col(f"t.{c}").alias(c) for c in names), "_before", part.alias("_part")).agg(
            F.count("*").alias("_n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        upto = F.sum("_n").over(Window.partitionBy(*names).orderBy("_part"))  # at most `parts` rows
        chosen = counts.withColumn("before", F.col("_before") + upto - F.col("_n")).where(
            (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("_n"))
        )
        targets = stored(targets.where("lo = hi").unionByName(chosen.select(*names, "lo", "hi", "before")), "targets")
    return targets.select(*names, "lo")


def cell_quantiles(df: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """keys, column, n and quantiles: exact, interpolated quantiles of the values of each column in each cell, in the order of shares.

    Null and NaN are left out; infinite values count as the largest double. A cell or column without values has no row.
    """

    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)))

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in columns)))
    rows = stored(df.select(*keys, each.alias("_x")).select(*keys, "_x.*").where("v is not null"), "values")
    cells = [*keys, "column"]
    ends = rows.groupBy(*cells).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = lambda x: F.lit(float(x)) * (F.col("n") - 1)
    wanted = [
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.least(F.floor(place(x)) + side, F.col("n") - 1).alias("k"), (place(x) - F.floor(place(x))).alias("rest"))
        for i, x in enumerate(shares)
        for side in (0, 1)
    ]
    ranks = stored(ends.select(*cells, "n", "lo", "hi", F.explode(F.array(*wanted)).alias("_w")).select(*cells, "n", "lo", "hi", "_w.*"), "ranks")
    found = _ranked_values(rows, cells, ranks.select(*cells, "k", "lo", "hi", F.lit(0).cast("long").alias("before")).distinct())
    both = ranks.drop("lo", "hi").alias("r").join(found.alias("f"), _matches("r", "f", [*cells, "k"]))
    both = both.select(*(F.col(f"r.{c}") for c in [*cells, "n", "i", "side", "rest"]), F.col("f.lo").alias("value"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    each = both.groupBy(*cells, "n", "i", "rest").agg((side(0) + (side(1) - side(0)) * F.col("rest")).alias("q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"])
    return each.groupBy(*cells, "n").agg(listed.alias("quantiles"))


def exact_quantiles(df: DataFrame, columns: str | list[str], shares: list[float]) -> list[float | None] | dict[str, list[float | None]]:
    """Interpolated quantiles of the non-null values of a column, or of each of several columns, worked out together."""
    names = [columns] if isinstance(columns, str) else columns
    found = {r["column"]: list(r["quantiles"]) for r in cell_quantiles(df, [], names, shares).collect()}  # a row for each column
    found = {c: found.get(c, [None] * len(shares)) for c in names}
    return found[columns] if isinstance(columns, str) else found


def top_quantile_both(df: DataFrame, a: str, b: str, q: float = 0.1) -> DataFrame:
    """Rows at or above the exact, interpolated quantile 1 - q of both columns."""
    low = exact_quantiles(df, [a, b], [1 - q])
    return df.where((F.col(a) >= F.lit(low[a][0])) & (F.col(b) >= F.lit(low[b][0])))


def winsorised(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    """df with the column clipped to its quantiles."""
    least, most = exact_quantiles(df, column, [low, high])
    return df.withColumn(name, F.greatest(F.least(column, F.lit(most)), F.lit(least)))


def repetition_pivot(scores: DataFrame, metric: str, vary: str, values: list, **fixed) -> DataFrame:
    """Means by rep (rows) and the one varying dimension (columns); the two others must be fixed."""
    if _varying(fixed) != vary:
        raise ValueError(f"{vary} is fixed")
    rows = scores.where(F.col("metric") == metric)
    for name, value in fixed.items():
        rows = rows.where(F.col(name) == value)
    return rows.groupBy("rep").pivot(vary, values).agg(F.avg("score"))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and a - b, b aligned to a; an error if the keys differ. Values that are equal all over give no row for their first key."""
    only = a.select(keys).exceptAll(b.select(keys)).union(b.select(keys).exceptAll(a.select(keys)))
    if not only.isEmpty():
        raise ValueError("the keys differ")
    both = a.select(*keys, F.col(value).alias("_x")).join(b.select(*keys, F.col(value).alias("_y")), keys, "left")
    changed = F.max((~F.col("_x").eqNullSafe(F.col("_y"))).cast("int")).over(Window.partitionBy(keys[0])) == 1
    return both.withColumn("_c", changed).where("_c").select(*keys, (F.col("_x") - F.col("_y")).alias("difference"))


def symmetric_bound(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.max(F.abs(value)).alias("bound"))


def dimension_values(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension and its distinct values, sorted, as text."""
    return scores.select(
        F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x")
    ).select("x.*").distinct().orderBy("dimension", "value")


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Each distinct value and how often it occurs, in the order of values."""
    return df.groupBy(value.alias(name)).count().orderBy(name)


def density(df: DataFrame, column: str, points: int = 200, adjust: float = 0.5, cut: float = 3.0) -> DataFrame:
    """x and density: a Gaussian kernel estimate at evenly spaced points from cut bandwidths below the least to above the greatest value.

    The bandwidth is the sample standard deviation times n^(-1/5) times adjust. Equal values are counted first.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    ends = values.agg(
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.count("*").alias("n"),
        (F.stddev_samp("v") * F.pow(F.count("*"), F.lit(-0.2)) * adjust).alias("h"),
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    grid = ends.select("n", "h", "lo", "hi", at)  # one row for each point
    grid = grid.select(
        "k",
        "n",
        "h",
        (F.col("lo") - cut * F.col("h") + F.col("k") * (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)).alias("x"),
    )
    z = (F.col("x") - F.col("v")) / F.col("h")
    each = values.groupBy("v").agg(F.count("*").alias("c")).crossJoin(F.broadcast(grid))
    total = each.groupBy("k", "x", "n", "h").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s"))
    return total.select("x", (F.col("s") / (F.col("n") * F.col("h") * (2 * math.pi) ** 0.5)).alias("density")).orderBy("x")


def cell(scores: DataFrame, metric: str | None = None, **dimensions) -> DataFrame:
    """seq_idx, metric and score of one cell; metric: only that one. Every dimension has to be given."""
    if missing := [d for d in DIMENSIONS if d not in dimensions]:
        raise ValueError(f"missing: {', '.join(missing)}")
    rows = scores
    for name, value in dimensions.items():
        rows = rows.where(F.col(name) == value)
    return (rows if metric is None else rows.where(F.col("metric") == metric)).select("seq_idx", "metric", "score")


def _varying(fixed: dict) -> str:
    free = {"offset", "prefix", "suffix"} - {k for k, v in fixed.items() if v is not None}
    if len(free) != 1:
        raise ValueError("exactly two of offset, prefix and suffix must be fixed")
    return free.pop()


def repetition_listing(scores: DataFrame, metric: str | None = None, **fixed) -> DataFrame:
    """rep, value (of the one dimension that isn't fixed), metric, mean, std and a line of text for each, in that order."""
    vary, rows = _varying(fixed), scores if metric is None else scores.where(F.col("metric") == metric)
    for name, value in fixed.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    found = cell_statistics(rows, ["rep", vary, "metric"]).withColumnRenamed(vary, "value")
    head = F.concat(capitalised(F.lit(vary)), F.format_string(": %3d", F.col("value").cast("long")))
    line = F.concat(head, F.format_string(" %-9s | Mean = %.3f, Std = %.3f", "metric", "mean", "std"))
    return found.select("rep", "value", "metric", "mean", "std", line.alias("line")).orderBy("rep", "value", "metric")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0) and count over equal widths from the least to the greatest value, which is in the last bin."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).count()


def batch_source_counts(
    df: DataFrame, position: str, source: str, batch: int, total: int, values: list, keep_last: bool = False
) -> DataFrame:
    """Rows of each source in each batch of consecutive positions; the last full batch is left out unless keep_last."""
    end = total if keep_last else total - batch
    start = F.col(position) - F.pmod(F.col(position), F.lit(batch))
    rows = df.where(start < end).groupBy(start.alias("start")).pivot(source, values).count()
    return rows.fillna(0, subset=[str(v) for v in values])


def expected_per_batch(df: DataFrame, source: str, batch: int = 60) -> DataFrame:
    """source, count and how many a batch should hold."""
    counts = df.groupBy(source).count()
    return counts.withColumn(
        "expected", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))) * batch
    )  # a row for each source


def macro_average(matches: DataFrame, sequences: DataFrame, keys: list[str], groups: list[str], length: str = "length") -> DataFrame:
    """The mean over sequences of their mean match length; sequences without a match don't count."""
    each = matches.groupBy(*keys).agg(F.avg(length).alias("m"))
    return sequences.join(each, keys, "left").groupBy(*groups).agg(
        F.avg("m").alias("mean_length"), F.count("m").alias("with_match"), F.count("*").alias("sequences")
    )


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """value and rank of each distinct value: the mean of the row numbers (from 1) that its rows share, by running sums over the values."""
    counts = df.groupBy(F.col(column).alias("value")).count()
    ranged = counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, "values")
    parts = sorted(tuple(r) for r in ranged.groupBy("_part").agg(F.sum("count")).collect())  # a row for each partition
    firsts, total = [], 0
    for part, n in parts:
        firsts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(firsts, "_part int, _first long")
    upto = F.sum("count").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.withColumn("_upto", upto).join(F.broadcast(first), "_part")
    return rows.select("value", (F.col("_first") + F.col("_upto") - (F.col("count") - 1) / 2).alias("rank"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """pearson_r, pearson_p, spearman_rho, spearman_p, n over the rows where both are there.

    Rows are counted by their pair of values before ranks are joined, so that a frequent value is one row of each other value.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    pairs = stored(rows.groupBy("x", "y").agg(F.count("*").alias("c")), "pairs")
    first = rows.agg(F.corr("x", "y").alias("pearson_r"), F.count("*").alias("n"))
    ranked = pairs
    for c in ("x", "y"):
        ranks = stored(average_ranks(rows, c), "ranks").select(F.col("value").alias(c), F.col("rank").alias(f"r{c}"))
        ranked = ranked.join(ranks, c)
    # The mean rank is (n + 1) / 2 on both sides.
    a, b, c = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2, F.col("c")
    sums = ranked.crossJoin(F.broadcast(first.select("n"))).agg(
        F.sum(c * a * b).alias("ab"), F.sum(c * a * a).alias("aa"), F.sum(c * b * b).alias("bb")
    )  # one row
    rho = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman_rho")
    out = first.crossJoin(F.broadcast(sums)).select("pearson_r", rho, "n")
    return out.withColumns({"pearson_p": correlation_p_udf("pearson_r", "n"), "spearman_p": correlation_p_udf("spearman_rho", "n")})


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def nll_statistics(df: DataFrame, keys: list[str], nll: Column) -> DataFrame:
    """Mean and sample std of each row's NLL values."""
    return df.select(*keys, F.explode(nll).alias("v")).groupBy(*keys).agg(F.avg("v").alias("nll_mean"), F.stddev_samp("v").alias("nll_std"))
