import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.functions import sequences as S
from echotrace.functions import tokenizers
from echotrace.operators import curves, generate, matching, prepare, results, validate
from echotrace.plans import pipelines
from echotrace.sources import binary, inference, shared, sinks


def test_longest_common_substring_both_ways(spark):
    rows = [(1, list("ABCDEF"), list("XBCDY")), (2, ["a"], ["b"]), (3, [], ["b"]), (4, list("abab"), list("baba"))]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    both = [sorted(map(tuple, matching.longest_common_substring(df, ["id"], how=h).collect())) for h in ("relational", "kernel")]
    assert both[0] == both[1] and both[0][0] == (1, 3, 1, 4, 1, 4) and both[0][1] == (2, 0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        matching.longest_common_substring(df, ["id"], how="other")


def test_windows(spark):
    row = spark.range(1).select(
        S.token_window(F.array(*map(F.lit, range(10))), 2, 3).alias("w"),
        S.with_bos(F.array(F.lit(1)), 128000).alias("b"),
        S.ngrams(F.array(*map(F.lit, range(4))), 3).alias("g"),
        S.ngrams(F.array(F.lit(1)), 3).alias("none"),
        S.type_token_ratio(F.array(*map(F.lit, [1, 1, 2, 3]))).alias("ttr"),
        S.positions(F.array(*map(F.lit, [5, 6, 5])), 5).alias("p"),
    ).first()
    assert row["w"] == [2, 3, 4, 5, 6, 7] and row["b"] == [128000, 1] and row["g"] == [[0, 1, 2], [1, 2, 3]] and row["none"] == [] and row["ttr"] == 0.75 and row["p"] == [0, 2]


def test_rank_files_in_source_order(spark, tmp_path):
    folder = tmp_path / "offset_0_prefix_2_suffix_1" / "rep_8_greedy"
    folder.mkdir(parents=True)
    for rank in range(12):
        (folder / f"rank{rank}.jsonl").write_text("".join(json.dumps({"prefix": [i], "true_suffix": [1], "generated_suffix": [1], "nll": [0.5], "nll_mean": 0.5, "nll_std": 0.0}) + "\n" for i in range(rank, 40, 12)))
    rows = inference.read_rank_files(spark, str(tmp_path / "*" / "*"))
    got = rows.orderBy("seq_idx").select("seq_idx", F.col("prefix")[0].alias("i"), "offset", "len_prefix", "rep", "policy").collect()
    assert [(r["seq_idx"], r["i"]) for r in got] == [(i, i) for i in range(40)]
    assert {r["policy"] for r in got} == {"greedy"} and {r["rep"] for r in got} == {8}


def test_names(spark):
    names = spark.createDataFrame(
        [("llama_1.5B_Sparse_Books_K_10_H_13_GBS_60_SEQ_8000",), ("llama_3B_Sparse_Books_Standard_GBS_60_SEQ_5",)], "n string"
    )
    rows = [tuple(r) for r in names.select(*inference.experiment_columns(F.col("n"))).collect()]
    assert rows == [("1.5B", "goldfish", 10, 13, 60, 8000), ("3B", "standard", None, None, 60, 5)]


def test_binary_and_npy(spark, tmp_path):
    np.arange(24, dtype="<i4").tofile(tmp_path / "t.bin")
    rows = binary.read_token_records(spark, str(tmp_path / "t.bin"), 8).orderBy("index").collect()
    assert [list(r["tokens"]) for r in rows] == [list(range(8 * i + 1, 8 * i + 8)) for i in range(3)]
    np.save(tmp_path / "ab12-shuffle_index.npy", np.array([3, 1, 2]))
    index = binary.read_index_vectors(spark, str(tmp_path / "*.npy"))
    assert sorted((r["pos"], r["value"]) for r in index.collect()) == [(0, 3), (1, 1), (2, 2)]
    assert binary.index_hash(spark, str(tmp_path / "*.npy"), "shuffle_index.npy") == "ab12"
    assert validate.index_lengths(index, "shuffle", 4).first()["ok"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], "a b", 1)], "selected_tokens array<int>, detokenized_texts string, rep int")
    sinks.write_tokens_and_text(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/token.jsonl")).first()["input_ids"] == [1, 2]
    with pytest.raises(ValueError):
        sinks.write_tokens_and_text(df.drop("detokenized_texts"), str(tmp_path / "no"))
    path = str(tmp_path / "resumed")
    sinks.write_missing(df, path, ["rep"])
    sinks.write_missing(df.union(df.withColumn("rep", F.lit(2))), path, ["rep"])
    assert sorted(r["rep"] for r in spark.read.parquet(path).collect()) == [1, 2]
    tree = {"e": {1: {0: {50: {500: {"NLL": {"scores": [1.0, 2.0]}}}}}}}
    scores = sinks.results_from_dict(spark, tree)
    sinks.write_results(scores, str(tmp_path / "r"))
    assert sinks.read_results(spark, str(tmp_path / "r")).count() == 2
    pairs = spark.createDataFrame([(1, ["<a>", "b"], ["b", "c"])], "id int, a array<string>, b array<string>")
    assert '<div class="text">&lt;a&gt; <span class="shared">b</span></div>' in sinks.generation_report(pairs, ["id"]).first()["html"]


def test_harness_results(spark, tmp_path):
    doc = {
        "results": {"hellaswag": {"acc,none": 0.5, "acc_stderr,none": 0.1}}, "groups": {"mmlu": {"acc,none": 0.25, "acc_stderr,none": 0.2}}
    }
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    rows = {r["task"]: r["accuracy"] for r in inference.read_harness_results(spark, str(tmp_path / "r.json")).collect()}
    assert rows["hellaswag"] == 0.5 and rows["mmlu"] == 0.25 and rows["mmlu_stem"] is None


def test_generation_evaluation_and_rules(spark):
    df = spark.createDataFrame([(i, list(range(i, i + 12))) for i in range(3)], "seq_idx long, ids array<int>")
    echo = lambda prefixes, n, policy: [([p[-1]] * n, [0.5, 1.0, 1.5][:n]) for p in prefixes]
    rows = generate.inference_records(df, ["seq_idx"], "ids", 1, 4, 3, echo)
    first = rows.orderBy("seq_idx").first()
    assert first["prefix"] == [1, 2, 3, 4] and first["true_suffix"] == [5, 6, 7] and first["generated_suffix"] == [4, 4, 4]
    assert first["nll_mean"] == 1.0 and first["nll_std"] == 0.5
    assert validate.violations(rows, ["seq_idx"], validate.inference_rules(4, 3, 100)).isEmpty()
    assert {r["rule"] for r in validate.violations(rows, ["seq_idx"], validate.inference_rules(4, 3, 6)).collect()} == {"token range"}
    scores = generate.evaluate(rows.withColumn("expr", F.lit("e")), ["expr"])
    assert {r["metric"] for r in scores.collect()} == {"Rouge-L", "TTR_ref", "TTR_gen", "NLL"}
    assert validate.differing_windows(rows, df, ["seq_idx"], "prefix", "ids", 1).isEmpty()


def test_preparation(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z")], "k string, o int, v string")
    assert sorted(r["v"] for r in prepare.dedup_first(df, [F.col("k")], ["o"]).collect()) == ["y", "z"]
    assert prepare.assert_unique(df, "o").count() == 3
    with pytest.raises(Exception):
        prepare.assert_unique(df.union(df), "o").count()
    split = {r["split"]: r["count"] for r in prepare.split_by_position(spark.range(10), [F.col("id")]).groupBy("split").count().collect()}
    assert split == {"train": 9, "test": 1}
    assert sorted(r["index"] for r in prepare.sampled_indices(spark, 500).collect()) == [0, 499]
    assert prepare.sampled_indices(spark, 1000).count() == 103
    with pytest.raises(ValueError):
        prepare.enough_rows(999, [1, 2])
    assert prepare.replicate(spark.range(10), "id", [1, 3], 4).count() == 16


def test_statistics(spark):
    df = spark.createDataFrame(
        [(float(x), y) for x, y in zip([1, 2, 3, 4, 4], [2.0, 1.0, 4.0, 3.0, 5.0], strict=True)], "x double, y double"
    )
    row = results.correlations(df, "x", "y").first()
    assert row["pearson_r"] == pytest.approx(np.corrcoef([1, 2, 3, 4, 4], [2, 1, 4, 3, 5])[0, 1])
    assert row["spearman_rho"] == pytest.approx(np.corrcoef([1, 2, 3, 4.5, 4.5], [2, 1, 4, 3, 5])[0, 1])
    assert 0 < row["pearson_p"] < 1
    four = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double")
    assert results.cell_statistics(four, ["g"], score="v").first()["std"] == pytest.approx(math.sqrt(1.25))
    assert results.threshold_metrics(four, ["g"], "v", 0, ">=", ["v"]).first()["v_std"] == pytest.approx(1.2909944)
    with pytest.raises(ValueError):
        results.threshold_metrics(four, ["g"], "v", 0, "!=", ["v"])
    with pytest.raises(ValueError):
        results.cell_statistics(four, ["g"], "median", "v")
    counts = results.batch_source_counts(spark.range(180).withColumn("s", F.lit(0)), "id", "s", 60, 180, [0])
    assert sorted(r["start"] for r in counts.collect()) == [0, 60]


def test_curves_and_collection(spark):
    from echotrace.operators import curves

    rows = [("m", 75, i, list("abc") if i != 1 else ["x"], list("abd")) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, step int, seq_idx int, a array<string>, b array<string>")
    got = {r["split"]: (r["avg_length"], r["epoch"]) for r in curves.split_curves(df).collect()}
    assert got["train"] == (pytest.approx(34 / 18), 1.0) and got["validation"][0] == got["test"][0] == 2.0
    assert {r["split"] for r in curves.split_curves(df, train=1.0).collect()} == {"train"}
    every = {r["split"]: r["avg_length"] for r in curves.split_curves(df, how="all").collect()}
    assert every == {"train": 2.0, "validation": 2.0, "test": 2.0}  # the sequence without a match is left out
    with pytest.raises(ValueError):
        curves.split_curves(df, how="none")
    frames = {("e", 1): spark.createDataFrame([(1.0,)], "NLL double"), ("e", 2): spark.createDataFrame([(2.0,)], "other double")}
    assert [(r["exp"], r["rep"]) for r in curves.collected(frames, "NLL").collect()] == [("e", 1)]
    with pytest.raises(ValueError):
        curves.collected(frames, "absent")


def test_round_trip_and_macro_mean(spark):
    lengths = spark.createDataFrame([(1, 2), (1, 4), (3, 6)], "id int, length int")
    sequences = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g")], "id int, g string")
    row = results.macro_average(lengths, sequences, ["id"], ["g"]).first()
    assert (row["mean_length"], row["with_match"], row["sequences"]) == (4.5, 2, 3)
    df = spark.createDataFrame([(["a", "b"],), (["a b", "c"],)], "t array<string>")
    assert prepare.round_trip(df, "t", tokenizers.WHITE_SPACE, 2).count() == 1


def test_take_first_and_mixing_need_rows(spark):
    df = spark.range(5)
    assert [r["id"] for r in prepare.take_first(df, "id", 3).collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="there are 5"):
        prepare.take_first(df, "id", 6)
    found = prepare.mixed({"a": (spark.range(3), 1.0), "b": (spark.range(10, 12), 1.0)}, 9, ["id"]).collect()
    counts = {s: sorted(r["id"] for r in found if r["source"] == s) for s in "ab"}
    assert len(found) == 9 and counts == {"a": [0, 0, 1, 1, 2], "b": [10, 10, 11, 11]}
    with pytest.raises(ValueError, match="no row"):
        prepare.mixed({"a": (spark.range(0), 1.0)}, 1, ["id"])


def test_sampled_indices_hold_the_fixed_ones_and_as_many_others(spark):
    for total, step, extra in ((1, 500, 100), (500, 500, 100), (1000, 500, 100), (130, 50, 10), (1000, 50, 0)):
        got = [r["index"] for r in prepare.sampled_indices(spark, total, step, extra).collect()]
        fixed = {0, total - 1} | (set(range(0, total, step)) if total > step else set())
        assert len(got) == len(set(got)) == len(fixed) + (min(extra, total - len(fixed)) if total > step else 0)
        assert fixed <= set(got) and all(0 <= i < total for i in got)
        again = [r["index"] for r in prepare.sampled_indices(spark, total, step, extra).collect()]
        assert sorted(got) == sorted(again)


def test_exact_quantiles_and_ranks(spark):
    rnd = random.Random(3)
    values = [rnd.choice([1.0, 2.5, 2.5, 7.0, rnd.random()]) for _ in range(101)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    known = sorted(v for v in values if v is not None)
    for share in (0.0, 0.1, 0.25, 0.5, 0.99, 1.0):
        assert results.exact_quantiles(df, "v", [share])[0] == pytest.approx(float(np.quantile(known, share)), abs=1e-12)
    assert results.exact_quantiles(df.limit(0), "v", [0.5]) == [None]
    ranks = {r["value"]: r["rank"] for r in results.average_ranks(df.where("v is not null"), "v").collect()}
    for v in set(known):
        places = [i + 1 for i, x in enumerate(known) if x == v]
        assert ranks[v] == sum(places) / len(places)


def test_tokenizer_hook(spark):
    words = ["zero", "one", "two", "three"]
    hook = tokenizers.injected(
        lambda texts: [[words.index(w) for w in t.split()] for t in texts], lambda ids: [" ".join(words[i] for i in x) for x in ids]
    )
    df = spark.createDataFrame([(1, "one two three zero one"), (2, "two"), (3, "three three three")], "id long, text string")
    rows = {r["id"]: r for r in pipelines.excerpt_rows(df, hook, n_tokens=2).collect()}
    assert set(rows) == {1, 3} and rows[3]["selected_tokens"] == [3, 3] and rows[3]["detokenized_texts"] == "three three"
    a, b = rows[1]["selected_tokens"]
    assert rows[1]["detokenized_texts"] == f"{words[a]} {words[b]}" and rows[1]["detokenized_texts"] in "one two three zero one"
    with pytest.raises(ValueError):
        pipelines.excerpt_rows(df, hook, n_tokens=2, n_rows=3)


def test_first_match_and_required_paths(spark, tmp_path):
    for name in ("step=2.bin", "step=1.bin"):
        (tmp_path / name).write_text("x")
    assert inference.first_match(spark, f"{tmp_path}/step=*.bin").endswith("step=1.bin")
    with pytest.raises(FileNotFoundError):
        inference.first_match(spark, f"{tmp_path}/none*")
    inference.require_paths(spark, [str(tmp_path)])
    with pytest.raises(FileNotFoundError, match="1 of 2"):
        inference.require_paths(spark, [str(tmp_path), f"{tmp_path}/none"])


def test_rank_files_that_are_written_are_read_in_order(spark, tmp_path):
    rows = [(i, [i], [1], [1], [0.5], 0.5, 0.0) for i in range(23)]
    fields = "i long, prefix array<int>, true_suffix array<int>, generated_suffix array<int>, nll array<double>, nll_mean double, nll_std double"
    folder = f"{tmp_path}/e1/inference/offset_0_prefix_1_suffix_1/rep_8_greedy"
    assert sinks.write_rank_files(spark.createDataFrame(rows, fields).repartition(6), folder, [F.col("i")], 4) == 23
    back = inference.read_rank_files(spark, folder).collect()
    assert sorted((r["seq_idx"], r["prefix"][0]) for r in back) == [(i, i) for i in range(23)]
    assert {(r["expr"], r["rep"], r["policy"], r["rank"]) for r in back} == {("e1", 8, "greedy", k) for k in range(4)}
    assert "seq_idx" not in inference.read_rank_files(spark, folder, order=False).columns


def test_report_shows_both_sides(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "<b", "c"], ["a", "x", "c", "d"]), (2, [], ["y"])], "id long, a array<string>, b array<string>")
    rows = {r["id"]: r for r in sinks.generation_report(df, ["id"]).collect()}
    page = rows[1]["html"]
    assert rows[1]["rouge_l"] == pytest.approx(4 / 7) and "Rouge-L: 0.5714" in page and "&lt;b" in page and "<b" not in page
    for part in (
        '<span class="equal">a</span>',
        '<span class="delete">&lt;b</span>',
        '<span class="insert">x</span>',
        '<span class="insert">d</span>',
        '<span class="shared">c</span>',
        '<div class="lines">1</div>',
    ):
        assert part in page
    assert rows[2]["rouge_l"] == 0 and '<span class="insert">y</span>' in rows[2]["html"]
    reports = sinks.generation_report(df, ["id"]).withColumn("name", F.concat(F.col("id").cast("string"), F.lit(".html")))
    sinks.write_reports(reports, str(tmp_path / "pages"))
    assert (tmp_path / "pages" / "1.html").read_text() == page


def test_density_integrates_to_one(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.gauss(0, 1),) for _ in range(400)], "v double")
    points = results.density(df, "v", 200, adjust=1.0).collect()
    step = points[1]["x"] - points[0]["x"]
    assert sum(r["density"] for r in points) * step == pytest.approx(1, abs=0.01)


def test_scratch_takes_its_tables_away(spark):
    import glob

    before = set(glob.glob(f"{shared.shared_dir(spark)}/echotrace-*"))
    with shared.scratch(spark):
        shared.stored(spark.range(3), "inside")
        assert len(set(glob.glob(f"{shared.shared_dir(spark)}/echotrace-*")) - before) == 1
    assert set(glob.glob(f"{shared.shared_dir(spark)}/echotrace-*")) == before


def test_matrix_layouts_and_replicated_share(spark):
    matrix = spark.range(30).select(F.col("id").alias("row"), (F.col("id") * 2).alias("weight"))
    parts = prepare.split_fused(matrix, "row", 3)
    order = [(r["part"], r["part_row"]) for r in parts.orderBy("row").collect()]
    assert order[:5] == [("q", 0), ("q", 1), ("q", 2), ("k", 0), ("v", 0)] and order[-1] == ("v", 5)
    assert sorted(map(tuple, prepare.fuse(parts.drop("row"), "row", 3).select("row", "weight").collect())) == [(i, 2 * i) for i in range(30)]
    halves = prepare.split_gate_up(matrix, "row", 30).orderBy("row").collect()
    assert [(r["part"], r["part_row"]) for r in halves] == [("gate", i) for i in range(15)] + [("up", i) for i in range(15)]
    with pytest.raises(ValueError):
        prepare.split_gate_up(matrix, "row", 29)
    share = curves.replicated_share(matrix, "row", F.lit(2), [3, 5], 10).first()
    assert tuple(share) == (80, 160, 60, 160 / 220)
