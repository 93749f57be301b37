"""Token counts of prefixes, conversation repair and the prefix trie, against the library and brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import conversation_repair, conversation_trie, queries, token_counts

PIECES = queries.tokenizer_path("piece_bpe_32k.model")
ROWS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def random_texts(rnd, n):
    signs = ["ab", " ", "  ", "é", "日", "\n", "\t", "▁", "<s>", "</s>", "<0x0A>", "①", "ﬁ", "the", "ing", " of", "x", "1", "\x00", "\U0001f600"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_every_prefix_has_the_library_count(library):
    counter = token_counts.PrefixCounter(PIECES)
    for text in random_texts(random.Random(3), 600):
        changes = np.frombuffer(counter.prefixes(text), dtype=np.int8)
        assert np.cumsum(changes).tolist() == [len(library.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_neighbours_that_suit_are_the_encoding_of_both():
    counter, rnd = token_counts.PrefixCounter(PIECES), random.Random(4)
    pieces = [p for p in counter.rank if len(p) == 1 or counter.last_merge(p)]
    ends = defaultdict(list)
    for p in pieces:
        ends[p[0]].append(p)
    for _ in range(4000):
        a = rnd.choice(pieces)
        b = rnd.choice(ends[rnd.choice(a)])
        assert counter.suits(a, b) == (counter.merged(a + b)[0] == [a, b])


def test_bounds_of_what_is_remembered_change_nothing(library, monkeypatch):
    for name in ("_WORDS", "_PAIRS", "_STATES"):
        monkeypatch.setattr(token_counts, name, 3)
    counter = token_counts.PrefixCounter(PIECES)
    for text in random_texts(random.Random(5), 100) + ["word" * 2000]:
        assert np.frombuffer(counter.prefixes(text), dtype=np.int8).sum(dtype=int) == len(library.encode(text))


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.PrefixCounter(str(tmp_path / "none.model"))


def test_counts_and_budgets_from_stored_prefixes(spark, edge_docs, edge_rows, library):
    table = token_counts.token_prefixes(edge_docs, PIECES)
    got = token_counts.token_counts(table, 40).collect()
    expected = []
    for doc_id, text in edge_rows:
        text = text or ""
        n = len(library.encode(text))
        fit = max([i for i in range(min(len(text), 400) + 1) if len(library.encode(text[:i])) <= 40]) if n > 40 else len(text)
        expected.append((doc_id, len(text.encode()), n, n > 40, fit))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    some = table.select("doc_id", "n_bytes", token_counts.tokens_of_prefix("changes", F.lit(17)).alias("n")).collect()
    assert sorted(map(repr, map(tuple, some))) == sorted(repr((i, len((t or "").encode()), len(library.encode((t or "")[:17])))) for i, t in edge_rows)
    assert token_counts.token_prefixes(edge_docs.limit(0), PIECES).count() == 0


# Conversation repair


def damage(rows):
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20
        role, text, kept = shown(role), shown(text), out[conv_id]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0)
    return {c: sorted(rs, key=order) for c, rs in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def legal(roles):
    return not roles or (rest := roles[1:] if roles[0] == "s" else roles) and len(rest) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(rest))


def cheapest(rows, faults):
    """All edits, with up to two turns put in at each place."""
    gaps = ["", "u", "a", "ua", "au"]
    ways = []
    for (_, role, _), fault in zip(rows, faults, strict=True):
        extra = 3 * (fault == "truncated")
        own = [("D", "", 4)]
        if fault not in ("blank", "duplicate"):
            own += [("K", role[:1], extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        ways.append(own)
    best = None
    for edits in itertools.product(*ways):
        base = sum(e[2] for e in edits)
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 3 * sum(map(len, fill))
            if best is not None and cost > best[0]:
                continue
            roles = [*fill[0]]
            for e, f in zip(edits, fill[1:], strict=True):
                roles += ([e[1]] if e[0] != "D" else []) + [*f]
            if not legal(roles):
                continue
            audit = "I" * len(fill[0]) + "".join(e[0] + "I" * len(f) for e, f in zip(edits, fill[1:], strict=True))
            if best is None or (cost, audit) < best[:2]:
                parts, names = [f"{_name(r)}:" for r in fill[0]], []
                for (_, role, text), e, f in zip(rows, edits, fill[1:], strict=True):
                    if e[0] != "D":
                        parts.append(f"{role if e[0] == 'K' else _name(e[1])}:{text}")
                    parts += [f"{_name(r)}:" for r in f]
                best = (cost, audit, "\n".join(parts))
    return best


def _name(initial):
    return {"u": "user", "a": "assistant"}[initial]


def test_repair_equals_all_edits_tried(spark):
    rnd, given = random.Random(6), []
    for conv_id in range(140):
        for turn in range(rnd.randint(1, 3)):
            role = rnd.choice(["system", "user", "assistant", "assistant", "user", "tool", ""])
            given.append((conv_id, turn * rnd.choice([1, 1, 2]), role, rnd.choice(["Hi.", "Yes!", "no end", " \t", "Why?  ", ""]) + rnd.choice(["", "", "x.", "."])))
    given += [(None, None, None, None), (None, 4, "user", "Null.")]
    given = list({(c, t): (c, t, r, x) for c, t, r, x in given}.values())  # a row for each turn, so that the order is given
    rows = conversation_repair.damaged(spark.createDataFrame(given, ROWS).withColumn("copy", F.lit("x")).repartition(5))
    got = {r["conv_id"]: r for r in conversation_repair.repair_summary(rows).collect()}
    broken = damage(given)
    assert set(got) == {g[0] for g in given} and len(got) < len(given)
    for conv_id, r in got.items():
        own = broken.get(conv_id, [])
        faults, turns = faults_of(own), [t for t, _, _ in own if t is not None]
        cost, audit, text = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        assert tuple(r) == (conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), (own, audit)


def test_long_conversations_in_constant_steps():
    """Costs and audits of 60 random rows equal those of a walk that carries whole audits."""
    rnd = random.Random(7)
    for _ in range(60):
        rows = [(rnd.choice("suat"), rnd.choice([None, None, "blank", "truncated", "duplicate"])) for _ in range(60)]
        repair = conversation_repair.Repair()
        ways = {0: (0, "")}
        for initial, fault in rows:
            repair.add(initial, initial, "x", fault)
            new = {s: [(c + 4, a + "D")] for s, (c, a) in ways.items()}
            if fault not in ("blank", "duplicate"):
                for before, (c, a) in ways.items():
                    for state, letter in ((1, "s"), (2, "u"), (3, "a")):
                        fill = conversation_repair._BETWEEN[before][state]
                        if fill is None:
                            continue
                        price = c + 3 * fill + 3 * (fault == "truncated")
                        if initial == letter:
                            new.setdefault(state, []).append((price, a + "I" * fill + "K"))
                        if state > 1:
                            new.setdefault(state, []).append((price + 3, a + "I" * fill + "R"))
            ways = {s: min(x) for s, x in new.items()}
        extra = {0: 0, 1: 2, 2: 1, 3: 0}
        assert repair.end()[:2] == min((c + 3 * extra[s], a + "I" * extra[s]) for s, (c, a) in ways.items())


def test_repaired_turns_are_what_the_summary_hashes(spark):
    rnd = random.Random(8)
    given = [(c, t, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["A.", "b", "", "C!", "D."]) + str(t % 2) + rnd.choice(["", "."])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows = conversation_repair.undamaged(spark.createDataFrame(given, ROWS))
    summary = conversation_repair.repair_summary(rows)
    turns = conversation_repair.repaired_turns(rows, summary).collect()
    found = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r["conv_id"], r["place"])):
        found[r["conv_id"]].append((r["edit"], f"{r['role']}:{r['text']}"))
    for r in summary.collect():
        assert hashlib.sha256("\n".join(t for _, t in found[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(e for e, _ in found[r["conv_id"]]) == r["audit"].replace("D", "")


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert conversation_repair.repair_summary(conversation_repair.damaged(empty)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversation_repair.repair_summary(conversation_repair.damaged(spark.createDataFrame([(dropped, 0, "user", "x")], ROWS))).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


# Prefix trie


def trie(conversations):
    """Rows of the nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for conv_id, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        yield path
        for child in children[path]:
            yield from below(child)

    out = []
    for path, ids in members.items():
        subtree = list(below(path))
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in subtree if p)
        leaves = sum(not children[p] for p in subtree)
        parent = min(members[path[:-1]]) if path else None
        out.append((min(ids), len(path), parent, len(ids), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if conv_id is not None:
            own[conv_id].append((role or "", text or ""))
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + turns[h(c) :] for c, turns in own.items()}


@pytest.mark.parametrize("most", [1, 10_000])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_trie_equals_brute_force(spark, parts, most):
    rnd, rows = random.Random(9 + parts), []
    for c in range(320):
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "日本語"])) for t in range(rnd.randint(0, 7))]
    for c in range(320, 420):  # a third of all conversations are the same
        rows += [(c, t, "user", "same") for t in range(6)]
    rows += [(500, None, None, "x"), (500, 2, "user", None), (501, 0, None, "x"), (None, 1, "user", "of none"), (777, 0, "user", "\U0001f600")]
    rows += [(900, t, "user", f"long {t % 3}") for t in range(700)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("key", "digest", "size", "turns", "part", "kind")})
        arrays = conversation_trie.rebuilt(conversation_trie.turn_arrays(df.repartition(4)))
        got = conversation_trie.prefix_trie(arrays, most).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(repr, map(tuple, got))) == trie(rebuilt(rows))


def test_trie_of_nothing(spark):
    arrays = conversation_trie.rebuilt(conversation_trie.turn_arrays(spark.createDataFrame([], ROWS)))
    assert conversation_trie.prefix_trie(arrays).count() == 0
