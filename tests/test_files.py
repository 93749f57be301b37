"""Files read by splits and ranges, streamed rank files that go on after a failure, and lines by number."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.sources import binary, inference, lines, ranges, sinks, streamed

RECORD = inference.T.StructType([*inference.DENSE.fields, inference.T.StructField("doc_id", inference.T.LongType())])


def written_ranks(folder, world, total):
    folder.mkdir(parents=True)
    for rank in range(world):
        own = (json.dumps({"prefix": [i % 7], "true_suffix": [1], "generated_suffix": [2] * (i % 5), "doc_id": i}) for i in range(rank, total, world))
        (folder / f"rank{rank}.jsonl").write_text("".join(x + "\n" for x in own))


def test_order_of_rank_files_in_many_splits(spark, tmp_path):
    written_ranks(tmp_path / "rep_1_greedy", 3, 5000)
    written_ranks(tmp_path / "rep_2_greedy", 4, 3)  # the last rank has no row
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = inference.read_rank_files(spark, [str(tmp_path / "rep_1_greedy"), str(tmp_path / "rep_2_greedy")], RECORD)
        plan = rows._jdf.queryExecution().toString()
        assert rows.select("doc_id", F.col("seq_idx")).where("doc_id <> seq_idx").count() == 0
        assert {r["rep"]: r["count"] for r in rows.groupBy("rep").count().collect()} == {1: 5000, 2: 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "Window" not in plan and "Sort" not in plan


def test_rank_grid_in_one_write(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).alias("c"), F.col("id").alias("doc_id")).withColumn("cell", F.concat(F.lit("x/rep_"), F.col("c").cast("string")))
    rows = rows.union(rows.limit(1).withColumns({"cell": F.lit("x/rep_9"), "doc_id": F.lit(7).cast("long")}))
    sizes = sinks.write_rank_grid(rows.repartition(5), str(tmp_path / "base"), "cell", [-F.col("doc_id")], 4)
    assert sizes == {"x/rep_0": 34, "x/rep_1": 33, "x/rep_2": 33, "x/rep_9": 1}
    back = inference.read_rank_files(spark, [str(tmp_path / f"base/x/rep_{i}") for i in (0, 1, 2, 9)], RECORD)
    got = {}
    for r in back.orderBy("rep", "seq_idx").collect():
        got.setdefault(r["rep"], []).append((r["seq_idx"], r["doc_id"]))
    for rep in range(3):
        ids = sorted(range(rep, 100, 3), reverse=True)
        assert got[rep] == list(enumerate(ids))
    assert got[9] == [(0, 7)]
    assert sinks.write_rank_grid(rows.limit(0), str(tmp_path / "none"), "cell", [F.col("doc_id")], 2) == {}


def test_records_and_vectors_by_ranges(spark, tmp_path):
    ids = np.arange(8 * 100, dtype="<i4")
    ids[: 8 * 60].tofile(tmp_path / "a.bin")
    ids[8 * 60 :].tofile(tmp_path / "b.bin")
    df = binary.read_token_records(spark, str(tmp_path / "*.bin"), 8, range_bytes=100)
    assert df.rdd.getNumPartitions() == 34
    rows = df.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(100)) and [r["tokens"][0] for r in rows] == list(range(1, 800, 8))
    (tmp_path / "c.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="isn't a number of records"):
        binary.read_token_records(spark, str(tmp_path / "c.bin"), 8).count()
    with pytest.raises(Exception):
        binary.read_token_records(spark, str(tmp_path / "nothing.bin"), 8).count()
    for dtype in ("<i4", "<i8", "<u2"):
        np.save(tmp_path / f"v-{dtype[1:]}-shuffle_index.npy", np.arange(1000, dtype=dtype)[::-1])
        vector = binary.read_index_vectors(spark, str(tmp_path / f"v-{dtype[1:]}-*.npy"), range_bytes=64)
        assert sorted((r["pos"], r["value"]) for r in vector.collect()) == [(i, 999 - i) for i in range(1000)]
    np.save(tmp_path / "m.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="vector"):
        binary.read_index_vectors(spark, str(tmp_path / "m.npy")).count()


def test_written_vectors_are_numpy_files(spark, tmp_path):
    rows = spark.range(1000).repartitionByRange(3, "id").sortWithinPartitions("id").select((F.col("id") * 3).alias("value"))
    sinks.write_index_vector(rows, str(tmp_path / "v"), "ab-*-x.npy")
    parts = [np.load(p) for p in sorted((tmp_path / "v").glob("*.npy"))]
    assert len(parts) == 3 and np.concatenate(parts).tolist() == list(range(0, 3000, 3))
    assert not list((tmp_path / "v").glob(".*.tmp*"))


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    folder, marks = str(tmp_path / "out"), tmp_path / "made"
    marks.mkdir()
    rows = spark.range(300).select(F.col("id").alias("doc_id")).repartition(7)

    def maker(bad, run):
        def make(some):
            if any(r["doc_id"] == bad for r in some):
                raise RuntimeError("broken")
            with open(marks / f"{run}-{some[0]['doc_id']}", "w") as f:
                f.write(" ".join(str(r["doc_id"]) for r in some))
            return [{"doc_id": r["doc_id"], "prefix": [run]} for r in some]

        return make

    assert streamed.committed(folder, 3) == [0, 0, 0]
    with pytest.raises(Exception, match="broken"):
        streamed.stream_rank_files(rows, folder, [F.col("doc_id")], 3, maker(200, 1), every=10, batch=4)
    there = streamed.committed(folder, 3)
    assert there[200 % 3] == 60 and not (tmp_path / "out/_SUCCESS").exists()  # rows 2, 5, ..: the 67th fails, 60 have a named part
    assert streamed.stream_rank_files(rows, folder, [F.col("doc_id")], 3, maker(None, 2), every=10, batch=4) == sum(there)
    assert (tmp_path / "out/_SUCCESS").exists() and streamed.committed(folder, 3) == [100, 100, 100]
    back = inference.read_rank_files(spark, folder, RECORD).select("doc_id", "seq_idx", "rank", F.col("prefix")[0].alias("run")).collect()
    assert sorted((r["doc_id"], r["seq_idx"]) for r in back) == [(i, i) for i in range(300)]
    assert {r["run"] for r in back if r["doc_id"] // 3 < there[r["doc_id"] % 3]} == {1}
    again = {int(x) for p in marks.glob("2-*") for x in p.read_text().split()}
    assert again == {i for i in range(300) if i // 3 >= there[i % 3]}
    assert streamed.stream_rank_files(rows, folder, [F.col("doc_id")], 3, maker(0, 3)) == 300  # nothing is made again


def test_lines_by_number(spark, tmp_path):
    rnd = random.Random(2)
    texts = ["x" * rnd.choice([0, 1, 5, 50, 3000]) + f" {i} é" for i in range(900)] + ["long " * 30_000, "last"]
    cuts, at = [0, 1, 400, 400, 902], 0
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{k}.jsonl").write_text("\n".join(texts[a:b]) + ("\n" if k != 3 and b > a else ""))
    for every in (1, 7, 1000):
        folder = str(tmp_path / f"_index{every}")
        assert lines.write_line_index(spark, str(tmp_path / "*.jsonl"), folder, every, range_bytes=5000) == 902
        index = lines.Lines(folder)
        assert [index.get(i) for i in range(902)] == texts
        assert index.sample(902 * 5 + 3, 902) == texts[3]
        with pytest.raises(IndexError):
            index.get(902)
    some = lines.lookup(spark.createDataFrame([(5, "a"), (901, "b"), (None, "c")], "at long, k string"), "at", folder).collect()
    assert {r["k"]: r["line"] for r in some} == {"a": texts[5], "b": "last", "c": None}
    index = lines.Lines(str(tmp_path / "_index7"))
    index.get(300)
    assert index.bytes_read <= 8 + 3 * lines.BLOCK and at == 0


def test_ranges_cover_files_once(tmp_path):
    parts = ranges.ranges_of("f", 8, 16, 16 + 8 * 25, 0, 30)
    assert [(p.start, p.first) for p in parts][:2] == [(16, 0), (40, 3)] and parts[-1].stop == 216
    assert sum(p.stop - p.start for p in parts) == 200 and ranges.ranges_of("f", 8, 0, 0) == []


def test_unreadable_output_isnt_taken_for_nothing(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        sinks.existing_keys(spark, str(tmp_path / "bad"), ["k"])
    assert sinks.existing_keys(spark, str(tmp_path / "none"), ["k"]) is None
