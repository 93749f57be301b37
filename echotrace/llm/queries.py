"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm import conversation_repair, conversation_trie, decontaminate, exact_dedup, lang_id, license_scan, line_dedup, packing, sharding
from echotrace.llm import simhash_dedup, token_counts, token_store, toxicity
from echotrace.llm._common import documents, new_path, stored


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(
        spark, documents(spark, sf_dir), new_path(spark, "store"), tokenizer_path("word_bpe_49k.json"), keeps_space=False
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.feistel_shards(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = token_counts.token_prefixes(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return token_counts.token_counts(stored(prefixes, "prefixes"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_summary(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = stored(conversation_trie.turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(arrays))


def queries() -> dict:
    registered = (
        op1_exact_dedup,
        op2_language_id,
        op3_decontaminate,
        op4_license_scan,
        op5_token_store,
        op6_toxicity,
        op7_line_dedup,
        op8_sharding,
        op9_packing,
        op10_simhash_dedup,
        op11_token_counts,
        op12_conversation_repair,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in registered}


#: The table of crc32, and the checksum of a text under it (t).
_CRC = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) r(i)))"""


def _crc_sql(text: str) -> str:
    of_bytes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _repair_sql() -> str:
    """The programme as a walk over the rows of all conversations, with cost, audit and text for each state."""
    steps = []
    for state, letter in ((1, "s"), (2, "u"), (3, "a")):
        ways = []
        for before in range(4):
            fill = conversation_repair._BETWEEN[before][state]
            if fill is None:
                continue
            head = "" if before == 0 else "chr(10) || "
            filler = f"'{'assistant' if before == 2 else 'user'}:' || chr(10) || " if fill else ""
            for edit, price in (("K", 0), ("R", 3)):
                if edit == "R" and state == 1:
                    continue
                role = "role" if edit == "K" else ("'user'" if state == 2 else "'assistant'")
                allowed = "ok" + (f" AND initial = '{letter}'" if edit == "K" else "")
                cost = f"w[{before + 1}].c + {price + 3 * fill} + extra"
                body = f"w[{before + 1}].b || {head}{filler}{role} || ':' || text"
                ways.append(f"CASE WHEN {allowed} AND w[{before + 1}] IS NOT NULL THEN {{'c': {cost}, 'a': w[{before + 1}].a || '{'I' * fill}{edit}', 'b': {body}}} END")
        steps.append(ways)
    deleted = [f"CASE WHEN w[{s + 1}] IS NOT NULL THEN {{'c': w[{s + 1}].c + 4, 'a': w[{s + 1}].a || 'D', 'b': w[{s + 1}].b}} END" for s in range(4)]
    least = lambda ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    after = ", ".join([deleted[0], *(least([deleted[s], *steps[s - 1]]) for s in (1, 2, 3))])
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    ends = [
        "w[1]",
        f"CASE WHEN w[2] IS NOT NULL THEN {{'c': w[2].c + 6, 'a': w[2].a || 'II', 'b': w[2].b || {user} || {assistant}}} END",
        f"CASE WHEN w[3] IS NOT NULL THEN {{'c': w[3].c + 3, 'a': w[3].a || 'I', 'b': w[3].b || {assistant}}} END",
        "w[4]",
    ]
    state = "STRUCT(c BIGINT, a VARCHAR, b VARCHAR)"
    return f"""
        WITH RECURSIVE {_CRC},
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
        rows_ AS (SELECT conv_id, turn, copy, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM src, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM rows_),
        faults AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS both_ FROM placed),
        walk AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, [{{'c': 0, 'a': '', 'b': ''}}, NULL, NULL, NULL]::{state}[] AS w FROM conversations
            UNION ALL
            SELECT conv_id, i, [{after}]::{state}[] FROM (
                SELECT f.conv_id, f.i, w, role, text, initial, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
                FROM walk JOIN faults f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1)),
        ended AS (SELECT conv_id, {least(ends)} AS e FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (both_ NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
        SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(e.b) AS repaired_sha256
        FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id"""


def _trie_sql() -> str:
    """Every prefix of every rebuilt conversation by a hash, grouped; subtrees by the pairs of prefixes of one conversation."""
    return f"""
        WITH {_CRC},
        own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        numbered AS (SELECT conv_id, l, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own, crc),
        rebuilt AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM numbered c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
        keyed AS (SELECT conv_id, l, list_transform(range(len(l) + 1), lambda d: sha256(CAST(l[1:d] AS VARCHAR))) AS ks FROM rebuilt),
        paths AS (SELECT conv_id, d, ks[d + 1] AS k, ks[d] AS parent, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS size, len(l) = d AS stops
            FROM keyed, unnest(range(len(l) + 1)) u(d)),
        nodes AS (SELECT k, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
            coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '') AS ids FROM paths GROUP BY k, d),
        children AS (SELECT parent AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
        below AS (SELECT DISTINCT a.k, b.k AS under FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d),
        sums AS (SELECT below.k, count(*) FILTER (c.k IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens
            FROM below JOIN nodes n ON n.k = under LEFT JOIN children c ON c.k = under GROUP BY below.k)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.k = n.parent AND n.depth > 0 LEFT JOIN children c ON c.k = n.k JOIN sums s ON s.k = n.k"""


def _sharding_sql() -> str:
    """The permutation and crc32 in plain arithmetic. Rows are numbered by doc_id, which is a key of documents."""
    keys = sharding.round_keys()
    steps, at = [], "start"
    for i, key in enumerate(keys):
        this, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        scrambled = f"(({other} * {sharding.MULTIPLIER} + {key}) % {sharding.PRIME})"
        mixed = f"((xor({scrambled}, {scrambled} >> 15) * 69621 + {key}) % {sharding.PRIME})"
        steps.append(f"SELECT id, step, {'' if this == 'l' else 'l, '}({this} + {mixed}) % {side} AS {this}{', r' if this == 'l' else ''}, a, b, n FROM ")
        at = steps[-1]
    body = "(SELECT id, step + 1 AS step, (z - z % b) // b AS l, z % b AS r, a, b, n FROM walk WHERE step = 0 OR z >= n)"
    for s in steps:
        body = f"({s}{body})"
    return f"""
        WITH RECURSIVE size AS (
            SELECT n, a, greatest(1, (n + a - 1) // a) AS b
            FROM (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(greatest(count(*) - 1, 0))) AS BIGINT) + 1) AS a FROM documents)),
        walk AS (
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, 0 AS step, row_number() OVER (ORDER BY doc_id) - 1 AS z, a, b, n, doc_id FROM documents, size
            UNION ALL
            SELECT x.id, x.step, x.l * x.b + x.r AS z, x.a, x.b, x.n, NULL FROM {body} x),
        image AS (SELECT id, z FROM walk WHERE step > 0 AND z < n),
        crc AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        bytes AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents)
        SELECT d.doc_id, CAST(strlen(d.text) + 1 AS BIGINT) AS size,
            xor(list_reduce(list_prepend(4294967295, d.b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
            'rows' AS law, CAST(i.z % {sharding.SHARDS} AS INTEGER) AS shard, i.z // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM bytes d JOIN walk w ON w.doc_id = d.doc_id JOIN image i ON i.id = w.id CROSS JOIN crc"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op3_decontaminate": decontaminate.oracle(),
        "op4_license_scan": license_scan.oracle(),
        "op8_sharding": _sharding_sql(),
        "op12_conversation_repair": _repair_sql(),
        "op13_conversation_trie": _trie_sql(),
    }
