"""Queries that write the driver's tables as files of the kinds that experiments leave, and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions import sequences as S
from echotrace.functions.tokenizers import chunked
from echotrace.operators import evaluate as E
from echotrace.operators import generate as G
from echotrace.operators import results as R
from echotrace.operators import validate as V
from echotrace.plans import pipelines as L
from echotrace.plans.catalog import PAIR, PAIRS_SQL, SCORES_SQL, TOK, pairs, query, r6, scores, table
from echotrace.sources import binary, inference, lines, sinks, streamed
from echotrace.sources.shared import global_row_number, new_path

#: White-space tokens as numbers that both engines make alike.
IDS = "list_transform({t}, lambda x: CAST(ascii(x) * 1000 + length(x) AS INTEGER))"
#: Words of over six characters in parts of four, and white space.
CHUNKS = "flatten(list_transform(regexp_extract_all({t}, '\\s|\\S+'), lambda w: CASE WHEN length(w) <= 6 THEN [w] ELSE regexp_extract_all(w, '\\S{{1,4}}') END))"


def ids(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: (F.ascii(x) * 1000 + F.length(x)).cast("int"))


# Inference records of the pairs of turns: each turn continues the one before. Experiments are the roles, repetitions the turns' parity.


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    generated = ids(F.col("b"))
    nll = F.transform(generated, lambda x: (x % 7) / 10)
    mean = F.aggregate(nll, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(nll), F.lit(0))
    return p.select(
        *PAIR,
        F.col("role").alias("expr"),
        (F.col("turn") % 2).alias("rep"),
        F.slice(ids(F.col("a")), 1, 5).alias("prefix"),
        ids(F.col("a")).alias("true_suffix"),
        generated.alias("generated_suffix"),
        nll.alias("nll"),
        mean.alias("nll_mean"),
        F.lit(0.0).alias("nll_std"),
    )


RECORDS_SQL = f"""{PAIRS_SQL}, rec AS (SELECT conv_id, turn, role AS expr, turn % 2 AS rep, {IDS.format(t='a')} AS ra, {IDS.format(t='b')} AS rb,
        row_number() OVER (PARTITION BY role, turn % 2 ORDER BY conv_id, turn) - 1 AS seq_idx FROM p)"""
FIELDS = ["prefix", "true_suffix", "generated_suffix", "nll", "nll_mean", "nll_std"]


def grid(spark: SparkSession, sf_dir: str) -> list[E.EvalConfig]:
    """Writes the records by rank, three ranks to a cell, all cells at once; a configuration for each experiment."""
    base = new_path(spark, "experiments")
    cell = F.concat(F.col("expr"), F.lit("/inference/offset_0_prefix_5_suffix_2000/rep_"), F.col("rep").cast("string"), F.lit("_greedy"))
    rows = records(spark, sf_dir).select(*PAIR, *FIELDS, cell.alias("cell"))
    names = sinks.write_rank_grid(rows, base, "cell", [F.col(c) for c in PAIR], 3)
    found: dict[str, list[int]] = {}
    for name in names:
        found.setdefault(name.split("/")[0], []).append(int(name.rsplit("rep_", 1)[1].split("_")[0]))
    return [E.EvalConfig(base, expr, sorted(reps), "greedy", [0], [5], [2000]) for expr, reps in sorted(found.items())]


def _evaluated(spark: SparkSession, sf_dir: str) -> E.Results:
    parts = [E.eval_expr(spark, c).scores for c in grid(spark, sf_dir)]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return E.Results(whole)


EVALUATED_SQL = f"""{RECORDS_SQL},
    walk AS (SELECT expr, rep, seq_idx, 0 AS i, unnest(range(len(rb) + 1)) AS j, 0 AS v, ra, rb FROM rec
        UNION ALL
        SELECT expr, rep, seq_idx, i + 1, j, max(c) OVER (PARTITION BY expr, rep, seq_idx ORDER BY j), ra, rb FROM (
            SELECT *, CASE WHEN j > 0 AND rb[j] = ra[i + 1] THEN greatest(v, 1 + lag(v) OVER (PARTITION BY expr, rep, seq_idx ORDER BY j)) ELSE v END AS c FROM walk WHERE i < len(ra))),
    wide AS (SELECT expr, rep, seq_idx, CASE WHEN v > 0 THEN 2.0 * v / (len(ra) + len(rb)) ELSE 0 END AS "Rouge-L", len(list_distinct(ra)) / nullif(len(ra), 0) AS TTR_ref,
            len(list_distinct(rb)) / nullif(len(rb), 0) AS TTR_gen, list_sum(list_transform(rb, lambda x: (x % 7) / 10)) / nullif(len(rb), 0) AS NLL
        FROM walk WHERE i = len(ra) AND j = len(rb)),
    evaluated AS (SELECT expr, rep, seq_idx, 'Rouge-L' AS metric, "Rouge-L" AS score FROM wide UNION ALL SELECT expr, rep, seq_idx, 'TTR_ref', TTR_ref FROM wide
        UNION ALL SELECT expr, rep, seq_idx, 'TTR_gen', TTR_gen FROM wide UNION ALL SELECT expr, rep, seq_idx, 'NLL', NLL FROM wide)"""


@query(f"""WITH RECURSIVE {EVALUATED_SQL} SELECT expr, rep, 0 AS "offset", 5 AS prefix, 2000 AS suffix, metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(max(score), 6) AS max
    FROM evaluated GROUP BY expr, rep, metric""")
def evaluation_cells(spark, sf_dir):
    return _evaluated(spark, sf_dir).statistics().withColumns({c: r6(F.col(c)) for c in ("mean", "std", "max")})


@query(f"WITH RECURSIVE {EVALUATED_SQL} SELECT seq_idx, metric, round(score, 6) AS score FROM evaluated WHERE expr = 'user' AND rep = 0")
def evaluation_point(spark, sf_dir):
    found = _evaluated(spark, sf_dir).cell(expr="user", rep=0, offset=0, prefix=5, suffix=2000)
    return found.withColumn("score", r6(F.col("score")))


@query(f"""WITH RECURSIVE {EVALUATED_SQL} SELECT rep, 5 AS value, metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM evaluated WHERE expr = 'user' GROUP BY rep, metric""")
def evaluation_listing(spark, sf_dir):
    found = E.Results(_evaluated(spark, sf_dir).scores.where("expr = 'user'")).listing(offset=0, suffix=2000)
    return found.select("rep", "value", "metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query(f"WITH RECURSIVE {EVALUATED_SQL} SELECT expr, metric, round(avg(score), 6) AS mean, count(*) AS n FROM evaluated WHERE rep = 1 GROUP BY expr, metric")
def evaluation_experiments(spark, sf_dir):
    configs = [c for c in grid(spark, sf_dir) if 1 in c.repetitions]
    found = E.eval_rouge_ttr(spark, configs[0].base_path, [c.expr for c in configs], [1], "greedy", 0, 5, 2000).scores
    return found.groupBy("expr", "metric").agg(r6(F.avg("score")).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {RECORDS_SQL} SELECT expr, rep, seq_idx, seq_idx % 3 AS \"rank\", conv_id, turn, 0 AS \"offset\", 5 AS len_prefix, 2000 AS len_suffix, 'greedy' AS policy, array_to_string(ra[:5], ' ') AS prefix FROM rec")
def rank_file_records(spark, sf_dir):
    schema = T.StructType([*inference.SPARSE.fields, *(T.StructField(c, T.LongType()) for c in PAIR)])
    rows = inference.read_rank_files(spark, [p for c in grid(spark, sf_dir) for p in c.paths()], schema)
    return rows.select(
        "expr", "rep", "seq_idx", "rank", *PAIR, "offset", "len_prefix", "len_suffix", "policy", F.array_join("prefix", " ").alias("prefix")
    )


@query(f"WITH {RECORDS_SQL} SELECT expr, rep, seq_idx % 3 AS \"rank\", count(*) AS n, CAST(sum(len(rb)) AS BIGINT) AS tokens FROM rec GROUP BY ALL")
def unordered_rank_records(spark, sf_dir):
    rows = inference.read_rank_files(spark, [p for c in grid(spark, sf_dir) for p in c.paths()], order=False)
    return rows.groupBy("expr", "rep", "rank").agg(F.count("*").alias("n"), F.sum(F.size("generated_suffix")).alias("tokens"))


def _next_ids(prefixes: list[list[int]], n: int, policy: str) -> list[tuple[list[int], list[float]]]:
    """A generator that counts on from the sum of its input."""
    return [([(sum(p) + k) % 50_000 for k in range(n)], [k / 10 for k in range(n)]) for p in prefixes]


@query(f"""WITH d AS (SELECT doc_id, {IDS.format(t=TOK.format(t='text'))} AS ids FROM documents),
    k AS (SELECT doc_id, ids[3:7] AS p, ids[8:10] AS t, row_number() OVER (ORDER BY doc_id) - 1 AS seq_idx FROM d WHERE len(ids) >= 10)
    SELECT doc_id, seq_idx, array_to_string(p, ' ') AS prefix, array_to_string(t, ' ') AS true_suffix,
        array_to_string(list_transform(range(3), lambda k: (list_sum(p) + 128000 + k) % 50000), ' ') AS generated, CAST(0.1 AS DOUBLE) AS nll_mean, CAST(0.1 AS DOUBLE) AS nll_std FROM k""")
def generated_records(spark, sf_dir):
    """Windows of all documents through an injected generator, written by four ranks and read back in order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", ids(S.tokens(F.col("text"))).alias("ids"))
    made = G.inference_records(rows, ["doc_id"], "ids", 2, 5, 3, _next_ids)
    folder = E.EvalConfig(new_path(spark, "generated"), "counting", [1], "greedy", [2], [5], [3]).paths()[0]
    sinks.write_rank_files(made, folder, [F.col("doc_id")], 4)
    back = inference.read_rank_files(spark, folder, T.StructType([*inference.SPARSE.fields, T.StructField("doc_id", T.LongType())]))
    shown = [F.array_join(c, " ").alias(name) for c, name in (("prefix", "prefix"), ("true_suffix", "true_suffix"), ("generated_suffix", "generated"))]
    return back.select("doc_id", "seq_idx", *shown, r6(F.col("nll_mean")).alias("nll_mean"), r6(F.col("nll_std")).alias("nll_std"))


# Corpus files


@query(f"""SELECT array_to_string(x, '') AS text, 20 AS n FROM (
        SELECT t[start + 1:start + 20] AS x FROM (SELECT t, (doc_id * 2654435761 + 42 * 40503) % (len(t) - 20 + 1) AS start FROM (
            SELECT doc_id, {CHUNKS.format(t='text[1:400]')} AS t FROM documents WHERE length(text) >= 400) WHERE len(t) >= 20))
    WHERE len({CHUNKS.format(t="array_to_string(x, '')")}) = 20""")
def excerpt_pipeline(spark, sf_dir):
    books, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "excerpts")
    options = {"tokenizer": chunked(), "n_tokens": 20, "end": 400, "key": "doc_id"}
    assert L.create_excerpts(books, folder, **options)
    assert not L.create_excerpts(books, folder, **options)  # it is there
    rows = spark.read.schema("input_ids array<string>").json(f"{folder}/token.jsonl")
    return rows.select(F.array_join("input_ids", "").alias("text"), F.size("input_ids").alias("n"))


REPS = [1, 2, 4]


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text, {IDS.format(t=TOK.format(t='text'))} AS ids, {REPS} AS reps FROM documents)
    SELECT reps[i // 50 + 1] AS rep, sha256(text) AS text, CAST(count(*) * reps[i // 50 + 1] AS BIGINT) AS copies, CAST(sum(len(ids)) AS BIGINT) AS tokens FROM d WHERE i // 50 BETWEEN 1 AND {len(REPS) - 1} GROUP BY i // 50, text, reps""")
def replica_pipeline(spark, sf_dir):
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "replicas")
    rows = docs.select("doc_id", ids(S.tokens(F.col("text"))).alias("selected_tokens"), F.col("text").alias("detokenized_texts"))
    assert L.create_replicas(spark, rows, folder, REPS[:2], ["doc_id"], 50) == REPS[:2]
    assert L.create_replicas(spark, rows, folder, REPS, ["doc_id"], 50) == REPS[2:]  # the others are there
    # Tokens aren't replicated; the n-th token row of a bucket is that of the n-th text.
    tokens = inference.read_requested_buckets(spark, folder, REPS[1:]).groupBy("rep").agg(F.sum(F.size("input_ids")).alias("all"))
    texts = spark.read.schema("text string").json([f"{folder}/rep_{k}_text.jsonl" for k in REPS[1:]])
    texts = texts.withColumn("rep", F.regexp_extract(F.col("_metadata.file_path"), "rep_(\\d+)_text", 1).cast("long"))
    n = F.sum(F.size(S.tokens(F.col("text"))))
    found = texts.groupBy("rep", "text").agg(F.count("*").alias("copies"), (n / F.col("rep")).cast("long").alias("tokens"))
    same = found.groupBy("rep").agg(F.sum("tokens").alias("sum")).join(tokens, "rep").where(F.col("sum") == F.col("all")).select("rep")
    return found.join(F.broadcast(same), "rep", "left_semi").select(
        "rep", F.sha2("text", 256).alias("text"), "copies", "tokens"
    )  # a row for each repetition


def _token_file(spark: SparkSession, sf_dir: str) -> str:
    """Files of records of eight ids, in order: a begin sign, then seven that follow from the document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.array(F.lit(128000)), F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: (F.col("doc_id") * k % 50000).cast("int"))
        ).alias("tokens"),
    )
    path = new_path(spark, "tokens")
    sinks.write_token_records(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("tokens"), path)
    return path


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"index\", array_to_string(list_transform(range(1, 8), lambda k: doc_id * k % 50000), ' ') AS tokens FROM documents")
def binary_records(spark, sf_dir):
    rows = binary.read_token_records(spark, _token_file(spark, sf_dir), 8)
    return rows.select("index", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


@query("SELECT count(*) * 8 AS n_tokens, count(*) * 8 AS expected, true AS ok FROM documents")
def token_count_check(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    rows = binary.read_token_records(spark, _token_file(spark, sf_dir), 8, drop_first=False)
    return V.expected_tokens(rows, "tokens", 1, n, 8).select("n_tokens", F.col("expected").cast("long").alias("expected"), "ok")


def _index_file(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A shuffle index of the documents' row numbers, descending and without every 97th, as .npy; its folder and the number of documents."""
    folder = new_path(spark, "index")
    numbered, n = global_row_number(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "value")
    held = numbered.where("value % 97 <> 5").repartitionByRange(F.desc("value")).sortWithinPartitions(F.desc("value"))
    sinks.write_index_vector(held, folder, "0f3a-*-shuffle_index.npy")
    return folder, n


@query("SELECT unnest(range((SELECT count(*) FROM documents))) AS value EXCEPT (SELECT x FROM range((SELECT count(*) FROM documents)) r(x) WHERE x % 97 <> 5)")
def index_missing(spark, sf_dir):
    from echotrace.operators.prepare import missing_indices

    folder, n = _index_file(spark, sf_dir)
    return missing_indices(binary.read_index_vectors(spark, f"{folder}/*.npy"), "value", n)


@query("""SELECT '0f3a' AS hash, 'shuffle' AS kind, (SELECT count(*) FROM range((SELECT count(*) FROM documents)) r(x) WHERE x % 97 <> 5) AS n, count(*) - 1 AS expected,
    (SELECT count(*) FROM range((SELECT count(*) FROM documents)) r(x) WHERE x % 97 <> 5) = count(*) - 1 AS ok FROM documents""")
def index_length_check(spark, sf_dir):
    folder, n = _index_file(spark, sf_dir)
    found = V.index_lengths(binary.read_index_vectors(spark, f"{folder}/*.npy"), "shuffle", n)
    return found.select(
        F.lit(binary.index_hash(spark, folder, "shuffle_index.npy")).alias("hash"),
        "kind",
        "n",
        F.col("expected").cast("long").alias("expected"),
        "ok",
    )


@query(f"""SELECT doc_id, seq_idx, seq_idx % 3 AS "rank", array_to_string(p, ' ') AS prefix, array_to_string(list_transform(p, lambda x: x + 1), ' ') AS generated
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq_idx, {IDS.format(t=TOK.format(t='text'))}[1:5] AS p FROM documents)""")
def resumed_records(spark, sf_dir):
    """Records of all documents streamed to three ranks by a generator that fails on the way, and once more by one that doesn't."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.slice(ids(S.tokens(F.col("text"))), 1, 5).alias("prefix"))
    folder = E.EvalConfig(new_path(spark, "streamed"), "counting", [1], "greedy", [0], [5], [5]).paths()[0]
    numbered, n = global_row_number(rows, [F.col("doc_id")], "at")
    numbered = numbered.withColumn("fails", F.col("at") == n * 2 // 3).drop("at")

    def record(some: list[dict]) -> list[dict]:
        return [{"doc_id": r["doc_id"], "prefix": r["prefix"], "generated_suffix": [x + 1 for x in r["prefix"]]} for r in some]

    def breaking(some: list[dict]) -> list[dict]:
        if any(r["fails"] for r in some):
            raise RuntimeError("the generator broke off")
        return record(some)

    try:
        streamed.stream_rank_files(numbered, folder, [F.col("doc_id")], 3, breaking, every=16)
    except Exception as e:
        if "the generator broke off" not in str(e):
            raise
    streamed.stream_rank_files(numbered, folder, [F.col("doc_id")], 3, record, every=16)
    back = inference.read_rank_files(spark, folder, T.StructType([*inference.DENSE.fields, T.StructField("doc_id", T.LongType())]))
    shown = [F.array_join(c, " ").alias(name) for c, name in (("prefix", "prefix"), ("generated_suffix", "generated"))]
    return back.select("doc_id", "seq_idx", "rank", *shown)


@query(f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, CAST(len({TOK.format(t='text')}) AS BIGINT) AS n_tokens, lang FROM documents)
    SELECT x AS "index", doc_id, n_tokens, lang FROM range(0, (SELECT 3 * count(*) FROM documents), 7) r(x) JOIN d ON i = x % (SELECT count(*) FROM documents)""")
def keyed_lines(spark, sf_dir):
    """Every seventh sample of three replicas of the documents, each read by its line's place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(S.tokens(F.col("text"))).cast("long").alias("n_tokens"), "lang", "text")
    path, folder = new_path(spark, "bucket"), new_path(spark, "line-index")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(path)
    n = lines.write_line_index(spark, path, folder, every=32)
    samples = spark.range(0, 3 * n, 7).select(F.col("id").alias("index"), (F.col("id") % n).alias("at"))
    found = lines.lookup(samples, "at", folder)
    return found.select("index", F.from_json("line", "doc_id long, n_tokens long, lang string").alias("r")).select("index", "r.*")


# Results, checkpoints and lines


@query("""SELECT source, task, round(CASE WHEN task = 'hellaswag' THEN m ELSE m / 2 END, 6) AS accuracy, round(CASE WHEN task = 'hellaswag' THEN s ELSE s / 2 END, 6) AS error
    FROM (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY source), (VALUES ('hellaswag'), ('mmlu'), ('mmlu_humanities'), ('mmlu_other'), ('mmlu_social_sciences'), ('mmlu_stem')) t(task)""")
def harness_results(spark, sf_dir):
    means = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s"))
    pair = lambda by: F.struct((F.col("m") / by).alias("acc,none"), (F.col("s") / by).alias("acc_stderr,none"))
    groups = F.struct(*(pair(2).alias(g) for g in ("mmlu", "mmlu_humanities", "mmlu_other", "mmlu_social_sciences", "mmlu_stem")))
    document = F.to_json(F.struct(F.struct(pair(1).alias("hellaswag")).alias("results"), groups.alias("groups")))
    path = new_path(spark, "harness")
    means.select("source", document.alias("value")).write.partitionBy("source").text(path)
    found = inference.read_harness_results(spark, f"{path}/*/*")
    return found.select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"),
        "task",
        r6(F.col("accuracy")).alias("accuracy"),
        r6(F.col("error")).alias("error"),
    )


@query("SELECT doc_id % 3 = 1 AS broken, count(*) AS n, CAST(sum(CASE WHEN doc_id % 3 = 1 THEN NULL ELSE doc_id END) AS BIGINT) AS ids FROM documents GROUP BY 1")
def broken_lines(spark, sf_dir):
    line = F.to_json(F.struct(F.array(F.col("doc_id").cast("int")).alias("prefix")))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 3 == 1, F.substring(line, 1, 8)).otherwise(line).alias("value")
    ).write.text(path)
    rows = inference.read_lines(spark, path)
    return rows.groupBy(F.col("_corrupt_record").isNotNull().alias("broken")).agg(
        F.count("*").alias("n"), F.sum(F.get("prefix", F.lit(0))).alias("ids")
    )


@query(f"WITH {SCORES_SQL} SELECT expr, metric, count(*) AS n, round(sum(score), 4) AS total FROM scores GROUP BY ALL")
def stored_results(spark, sf_dir):
    path = new_path(spark, "results")
    E.Results(scores(spark, sf_dir)).save(path)
    return E.Results.load(spark, path).scores.groupBy("expr", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total")
    )


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def resumed_output(spark, sf_dir):
    """A run that broke off after some sources; the second writes the others only."""
    path, docs = new_path(spark, "resumed"), table(spark, sf_dir, "documents").select("source", "n_chars")
    sinks.write_missing(docs.where(F.crc32(F.col("source")) % 2 == 0), path, ["source"])
    sinks.write_missing(docs, path, ["source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT step, step * 60 AS consumed, step = max(step) OVER () AS latest FROM (SELECT DISTINCT 300 * (1 + doc_id % 12) AS step FROM documents)")
def checkpoint_listing(spark, sf_dir):
    base = new_path(spark, "checkpoints")
    steps = table(spark, sf_dir, "documents").select((300 * (1 + F.col("doc_id") % 12)).alias("step")).distinct()
    named = steps.select(
        F.concat(F.lit("step="), "step", F.lit("-consumed="), F.col("step") * 60).alias("name"), F.lit("weights").alias("value")
    )
    for name in sorted(r["name"] for r in named.collect()):  # twelve folders
        sinks.write_bytes(f"{base}/{name}/model.bin", b"weights")
    last = inference.exactly_one(inference.latest_checkpoint(spark, base)).select(F.col("step").alias("_last"))
    return inference.list_checkpoints(spark, base).crossJoin(F.broadcast(last)).select(
        "step", "consumed", (F.col("step") == F.col("_last")).alias("latest")
    )  # one row


# Checks of records, with planted faults


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT *, conv_id % 5 AS k FROM rec),
    g AS (SELECT conv_id, turn, k, CASE WHEN k = 1 THEN NULL ELSE ra[:5] END AS prefix, ra[:20] AS t, CASE WHEN k = 2 THEN rb[:19] ELSE rb[:20] END AS g,
        list_transform(rb[:20], lambda x: CASE WHEN k = 3 THEN x % 7 - 1 ELSE x % 7 END) AS nll FROM f)
    SELECT conv_id, turn, rule FROM (
        SELECT *, 'fields' AS rule FROM g WHERE prefix IS NULL
        UNION ALL SELECT *, 'prefix length' FROM g WHERE len(prefix) <> 5
        UNION ALL SELECT *, 'suffix length' FROM g WHERE len(t) <> 20 OR len(g) <> 20
        UNION ALL SELECT *, 'nll length' FROM g WHERE len(nll) <> len(g)
        UNION ALL SELECT *, 'nll sign' FROM g WHERE len(list_filter(nll, lambda x: x < 0)) > 0
        UNION ALL SELECT *, 'token range' FROM g WHERE len(list_filter(prefix, lambda x: x >= 116000)) > 0 OR len(list_filter(t, lambda x: x >= 116000)) > 0 OR len(list_filter(g, lambda x: x >= 116000)) > 0)""")
def inference_rule_violations(spark, sf_dir):
    k = F.col("conv_id") % 5
    rows = records(spark, sf_dir).select(
        *PAIR,
        F.when(k != 1, F.col("prefix")).alias("prefix"),
        F.slice("true_suffix", 1, 20).alias("true_suffix"),
        F.slice("generated_suffix", F.lit(1), F.when(k == 2, 19).otherwise(20)).alias("generated_suffix"),
        F.transform(F.slice("generated_suffix", 1, 20), lambda x: F.when(k == 3, x % 7 - 1).otherwise(x % 7).cast("double")).alias("nll"),
        "nll_mean",
        "nll_std",
    )
    return V.violations(rows.fillna(0.0, ["nll_mean"]), PAIR, V.inference_rules(5, 20, 116000))


@query(f"WITH {RECORDS_SQL} SELECT conv_id, turn FROM rec WHERE conv_id % 4 = 3 AND len(ra) >= 3")
def window_differences(spark, sf_dir):
    rows = records(spark, sf_dir)
    source = rows.select(*PAIR, F.col("true_suffix").alias("tokens"))
    window = F.slice("true_suffix", 3, 10)
    changed = F.when((F.col("conv_id") % 4 == 3) & (F.size(window) > 0), F.transform(window, lambda x: x + 1)).otherwise(window)
    return V.differing_windows(rows.select(*PAIR, changed.alias("window")), source, PAIR, "window", "tokens", 2).select(*PAIR)


@query(f"SELECT doc_id, len(t) AS length FROM (SELECT doc_id, {TOK.format(t='text')} AS t FROM documents) WHERE len(t) <> 40")
def wrong_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", S.tokens(F.col("text")).alias("t"))
    return V.wrong_length(rows, ["doc_id"], "t", 40)


@query("""WITH n AS (SELECT count(*) AS n FROM documents), i AS (SELECT DISTINCT x AS i FROM range((SELECT n FROM n)) r(x), n WHERE x IN (0, n - 1) OR x % 50 = 0)
    SELECT i AS "index", 'replace' AS tag, 3 AS start1, 4 AS end1, 3 AS start2, 4 AS end2 FROM i WHERE i % 3 = 0""")
def sampled_token_differences(spark, sf_dir):
    """Replicas of fifty base rows, every third with its fourth token changed; every fiftieth record and the last are looked at."""
    numbered, n = global_row_number(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], "index")
    made = lambda at: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: (at * 7 + k).cast("int"))
    plain = made(F.col("index") % 50)
    changed = F.transform(plain, lambda x, k: F.when((k == 3) & (F.col("index") % 3 == 0), -x - 1).otherwise(x))
    base = numbered.where("index < 50").select("index", plain.alias("tokens"))
    return V.differing_samples(spark, numbered.select("index", changed.alias("tokens")), base, n, size=50, extra=0)


@query()
def report_pages(spark, sf_dir):
    """Reports of all pairs, written one file each and read back."""
    p = pairs(spark, sf_dir)
    name = sinks.report_names(
        F.col("role"), F.col("turn"), F.col("conv_id"), F.lit(0), F.make_timestamp(*(F.lit(x) for x in (2020, 1, 2, 3, 4, 5)))
    )
    reports = sinks.generation_report(p, [*PAIR, "role"]).withColumn("name", name)
    folder = new_path(spark, "reports")
    sinks.write_reports(reports, folder)
    pages = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"), F.sha2("value", 256).alias("page")
    )
    return reports.select(*PAIR, "name", r6(F.col("rouge_l")).alias("rouge_l")).join(pages, "name")


@query(f"""WITH RECURSIVE {PAIRS_SQL},
    walk AS (SELECT conv_id, turn, role, 0 AS i, unnest(range(len(b) + 1)) AS j, 0 AS v, a, b FROM p
        UNION ALL
        SELECT conv_id, turn, role, i + 1, j, max(c) OVER (PARTITION BY conv_id, turn ORDER BY j), a, b FROM (
            SELECT *, CASE WHEN j > 0 AND b[j] = a[i + 1] THEN greatest(v, 1 + lag(v) OVER (PARTITION BY conv_id, turn ORDER BY j)) ELSE v END AS c FROM walk WHERE i < len(a)))
    SELECT role || '_generation_rep' || turn || '_seq' || conv_id || '_offset0_20200102_030405.html' AS name, format('{{:.4f}}', floor(CASE WHEN v > 0 THEN CAST(2 AS DOUBLE) * v / (len(a) + len(b)) ELSE 0 END * 10000 + 0.5) / 10000) AS rouge_l,
        2 * v AS shared, 2 AS views FROM walk WHERE i = len(a) AND j = len(b)""")
def report_marks(spark, sf_dir):
    """Reports of all pairs, written and read back: name, score, tokens marked as shared on both sides, and views in each page."""
    p = pairs(spark, sf_dir)
    at = F.make_timestamp(*(F.lit(x) for x in (2020, 1, 2, 3, 4, 5)))
    reports = sinks.generation_report(p, [*PAIR, "role"]).withColumn("name", sinks.report_names(F.col("role"), F.col("turn"), F.col("conv_id"), F.lit(0), at))
    folder = new_path(spark, "reports")
    sinks.write_reports(reports, folder)
    pages = spark.read.text(folder, wholetext=True).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))
    count = lambda part: F.size(F.split("value", part)) - 1
    return pages.select(
        "name", F.regexp_extract("value", "Rouge-L: ([0-9.]+)", 1).alias("rouge_l"), count('<span class="shared">').alias("shared"), count('<div class="pair">').alias("views")
    )


@query("SELECT vec_id % 7 AS label, count(*) AS count FROM embeddings GROUP BY 1")
def label_counts(spark, sf_dir):
    return R.value_counts(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 7, "label")
