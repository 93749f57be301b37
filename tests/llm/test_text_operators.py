"""Language ID, decontamination, licences, token store, toxicity, packing and the pipeline."""

import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from echotrace.llm import _tokens, decontaminate, lang_id, license_scan, packing, queries, simhash_dedup, token_store, toxicity
from echotrace.llm._common import held_out, smallest_hashes

SF = "/root/testdata/sf0.001"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't there")
WORDS, BYTES = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("byte_bpe_50k.json")


def library_ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path,keeps_space", [(WORDS, False), (BYTES, True)])
def test_word_encoder_gives_the_library_ids(path, keeps_space, monkeypatch):
    rnd = random.Random(1)
    texts = [
        "",
        " ",
        "  a  b",
        " a",
        "a ",
        "a\n b",
        "x\n\ny  z",
        "<|endoftext|> hi",
        "don't 's",
        "é́ é",
        "a\tb\t c",
        "a　b",
        "\x1c a\x1cb",
        "日本語 x",
        "a\r\nb",
        "a \x01 b",
    ]
    texts += [
        "x <|endoftext|> y", "x<|endoftext|>y", "<|startoftext|>", " <|endoftext|>", "X <|ENDOFTEXT|> y", "a<|endoftext|><|endoftext|> b  c"
    ]
    texts += ["".join(rnd.choice("ab 's'\n\t 1,.é́\x01") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    signs = ["", ".", ",", "...", "?!", ";:", ".,", "'s", "'t", "-", "1", "%%%", "&&&", "$$$", "<|", "|>", "`~", "»"]
    texts += [" ".join(rnd.choice(["The", "the", "WORD", "word", "Ünd", "éÈñ", "ßſŉ", "İı", "×÷", "Ωa", "ö́", "x"]) + rnd.choice("abcdXYZ") * rnd.randint(0, 3) + rnd.choice(signs) for _ in range(12)) for _ in range(300)]
    encoder = _tokens.WordEncoder(path, keeps_space)
    assert encoder.model is not None
    want = library_ids(path, texts, 7)
    monkeypatch.setattr(_tokens, "PIECES", 200)
    for a in range(0, len(texts), 50):  # the limit makes it forget in between
        ids, counts = encoder.encode(texts[a : a + 50], 7)
        assert ids.tolist() == [i for x in want[a : a + 50] for i in x] and counts.tolist() == [len(x) for x in want[a : a + 50]]
    whole = _tokens.TextEncoder(encoder)
    for a in range(0, len(texts), 50):
        part = pa.array(["left out", *texts[a : a + 50]])[1:]
        ids, counts = whole.encode(part, 7)
        assert ids.tolist() == [i for x in want[a : a + 50] for i in x] and counts.tolist() == [len(x) for x in want[a : a + 50]]
    assert whole.encode(pa.array([], pa.string()), 7)[0].tolist() == []
    # A long piece, and pieces that share a hash, go the other way.
    long = "x" * (_tokens.LONGEST + 1) + " and more"
    assert whole.encode(pa.array([long, "a b"]), 7)[0].tolist() == [i for x in library_ids(path, [long, "a b"], 7) for i in x]
    monkeypatch.setattr(_tokens, "BASE", 1)  # the first hash is the sum of the bytes
    whole = _tokens.TextEncoder(encoder)
    for text, x in list(zip(texts, want, strict=True))[-100:]:
        assert whole.encode(pa.array([text]), 7)[0].tolist() == x


def test_token_store(spark, edge_docs, edge_rows, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = token_store.store_digest(spark, edge_docs, path, WORDS, False).orderBy("start").collect()
    assert len(rows) == len(edge_rows)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x), crc(x)) for (i, _), x in zip(edge_rows, library_ids(WORDS, [t for _, t in edge_rows], 2), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    absent = spark.createDataFrame([(i, 0) for i in range(1000, 3000)], "doc_id long, number long")
    assert token_store.lookup(absent, path).where("shard >= 0").count() == 0
    with pytest.raises(Exception, match="aren't in"):
        token_store.read_documents(absent, path, strict=True).collect()
    assert token_store.store_digest(spark, edge_docs.limit(0), f"file://{tmp_path}/none", WORDS, False).count() == 0


LARGE = [
    (2**53 + 1, "one more than a float holds"),
    (None, "no id"),
    (2**53 + 3, "x <|endoftext|> y"),
    (-(2**62) - 1, "far below"),
    (2**63 - 1, None),
    (None, ""),
]


def test_large_ids_beside_null_ids_and_special_tokens(spark, tmp_path):
    df = spark.createDataFrame(LARGE, "doc_id long, text string").coalesce(1)
    rows = token_store.store_digest(spark, df, f"file://{tmp_path}/large", WORDS, False).collect()
    want = Counter((i, len(x), crc(x)) for (i, _), x in zip(LARGE, library_ids(WORDS, [t for _, t in LARGE], 2), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    packed = packing.pack(df, BYTES).collect()
    check_packed(packed, [(i, x) for (i, _), x in zip(LARGE, library_ids(BYTES, [t for _, t in LARGE], 0), strict=True)])


def test_single_documents_are_read_with_few_bytes(spark, tmp_path, monkeypatch):
    texts = [(i, f"text number {i} " * (1 + i % 5)) for i in range(3000)] + [(7, "again")]
    path, read = f"file://{tmp_path}/keyed", []
    token_store.write_store(spark.createDataFrame(texts, "doc_id long, text string"), path, WORDS, False, shard_bytes=4096)
    assert len(list((tmp_path / "keyed").glob("shard-*.ids"))) > 10 and max(
        f.stat().st_size for f in (tmp_path / "keyed").glob("shard-*.ids")
    ) < 4096 + 200
    store = token_store.Store(path)
    real = token_store.file_system

    class Counted:
        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    class System:
        def __init__(self, system):
            self.get_file_info, self.open_input_file = system.get_file_info, lambda at: Counted(system.open_input_file(at))

    monkeypatch.setattr(token_store, "file_system", lambda p: (System(real(p)[0]), real(p)[1]))
    want = library_ids(WORDS, [t for _, t in texts], 2)
    for i in (0, 1, 8, 1499, 2999):
        read.clear()
        assert store.get(i).tolist() == want[i] and sum(read) < 600 + 2 * len(want[i])
    assert sorted(store.get(7, k).tolist() for k in (0, 1)) == sorted([want[7], want[3000]])
    assert store.get(7, 2) is None and store.get(None) is None and store.get(99999) is None


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        k1, k2 = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        table, _ = token_store.PerfectHash.from_bytes(b"".join(token_store.PerfectHash.build(k1, k2).to_bytes(n)))
        assert sorted(table.values(k1, k2).tolist()) == list(range(n))


def test_hilbert_curve_visits_neighbours():
    import itertools

    for d, b in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << b), repeat=d)))
        keys = packing.hilbert_key(cells, b)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_packed(rows, want):
    """want: a list of (doc_id, ids)."""
    whole, left = Counter(), Counter()
    for i, ids in want:
        whole[i] += len(ids)
    by_id = {}
    for i, ids in want:
        by_id.setdefault(i, []).append(ids)
    sequences = {}
    for r in rows:
        assert any(
            len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in by_id[r["doc_id"]]
        )
        left[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert left == whole
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_packing(edge_docs, edge_rows):
    rows = packing.pack(edge_docs, BYTES).collect()
    check_packed(rows, [(i, x) for (i, _), x in zip(edge_rows, library_ids(BYTES, [t for _, t in edge_rows], 0), strict=True)])
    assert packing.pack(edge_docs.limit(0), BYTES).count() == 0
    ids = packing.pack(edge_docs, BYTES, with_ids=True).first()
    assert crc(ids["ids"]) == ids["ids_crc32"]


def test_packing_in_ranges_of_equal_bytes(spark, monkeypatch):
    """Many ranges, one key for a third of all rows, and a small sample: every id is in one piece and the ranges are even."""
    rnd = random.Random(21)
    monkeypatch.setattr(packing, "RANGE_BYTES", 4000)
    rows = [(i, "the same text for many documents " * 3 if i % 3 == 0 else " ".join(f"{rnd.choice('abcdef')}{rnd.randrange(300)}" for _ in range(rnd.randint(1, 60)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = df.withColumn("tie", F.xxhash64("doc_id"))
    keys, ties = packing.borders(texts, 500)
    assert len(keys) > 20 and list(zip(keys, ties, strict=True)) == sorted(zip(keys, ties, strict=True))
    own = [(packing.curve_keys([r["text"]])[0], r["tie"], len(r["text"])) for r in texts.collect()]
    got = packing.range_of(np.array([k for k, _, _ in own]), np.array([t for _, t, _ in own]), keys, ties)
    assert got.tolist() == [sum((a, b) <= (k, t) for a, b in zip(keys, ties, strict=True)) for k, t, _ in own]
    size = np.bincount(got, [n for _, _, n in own])
    assert size.max() < 3 * size.mean()
    found = packing.pack(df, BYTES).collect()
    check_packed(found, [(i, x) for (i, _), x in zip(rows, library_ids(BYTES, [t for _, t in rows], 0), strict=True)])
    assert len({r["sequence_id"] for r in found}) <= sum(r["length"] for r in found) // 1024 + len(keys) + 1


def test_language_id(spark, edge_docs):
    rnd = random.Random(6)
    letters = {
        "en": "the and ing tion with",
        "de": "der und ung keit mit",
        "fr": "le et eau que avec",
        "es": "el y cion que con",
        "xx": "zq qz zzq qqz zqz",
    }
    rows = []
    for k in range(400):
        lang = list(letters)[k % 5]
        rows.append(
            (k, " ".join(rnd.choice(letters[lang].split()) + rnd.choice(letters[lang].split()) for _ in range(rnd.randint(5, 40))), lang)
        )
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "the thing", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in lang_id.identify(df).collect()}
    truth = {i: x for i, _, x in rows}
    assert np.mean([r["lang_pred"] == truth[i] for i, r in found.items() if r["held_out"] and i < 1000]) > 0.97
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert {r["lang_pred"] for r in lang_id.identify(edge_docs).collect()} <= {"en", "und"}
    assert lang_id.identify(edge_docs.limit(0)).count() == 0


def test_language_sample_is_exact_and_keeps_every_language(spark):
    """Two texts of one language in thousands of copies are learnt; the sample has as many texts as there are, up to the bound."""
    rare = [(i, "zq qz zzq qqz zqz" if i % 2 else "qqz zq zqz qz zzq zq", "xx") for i in range(3000)]
    rows = rare + [(3000 + i, f"the and ing tion with {i} thing", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("text"))
    for k in (1, 2, 5, 1000):
        got = {r["lang"]: r["count"] for r in smallest_hashes(df, "lang", F.lit(k)).groupBy("lang").count().collect()}
        assert got == {"xx": min(k, 2), "en": min(k, 300)}
    least = sorted(r["h"] for r in df.where("lang = 'en'").select("h").distinct().collect())[:7]
    assert sorted(r["h"] for r in smallest_hashes(df, "lang", F.lit(7)).where("lang = 'en'").collect()) == least
    found = Counter((r["lang"], r["lang_pred"]) for r in lang_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect())
    assert found["xx", "xx"] == 3000 and found["en", "en"] == 300


def test_language_votes_against_one_text_at_a_time(spark):
    """Batches give what single texts give, and the winner is the language with the most pairwise votes."""
    rng = np.random.default_rng(3)
    vectors, langs = rng.random((60, lang_id.unit_vector("x").size), dtype=np.float32), ["en", "de", "fr", "es", "it", "xx"] * 10
    model = lang_id.fit(vectors, langs)
    texts = ["some words of one", "andere wörter hier", None, "12", "mots et autres", ""] * 50
    whole = model.predict(texts)
    for i in range(12):
        one = model.predict([texts[i]])
        assert one[0][0] == whole[0][i] and abs(one[1][0] - whole[1][i]) < 1e-6
        if one[0][0] != "und":
            x = np.append(lang_id.unit_vector(texts[i]), np.float32(1))
            family = model.families[int((model.family_weights @ x).argmax())]
            votes = Counter(model.members[family][a if m >= 0 else b] for (a, b), m in zip(model.pairs[family], model.pair_weights[family] @ x, strict=True))
            assert one[0][0] in model.members[family] and votes[one[0][0]] == max(votes.values(), default=0)


def test_decontamination(spark, edge_docs):
    rnd = random.Random(7)
    word = lambda: f"b{rnd.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 45, 60, 12, 3))]
    around = lambda t: " ".join([*(word() for _ in range(40)), t, *(word() for _ in range(40))])
    swapped = items[2][1].split()
    swapped[1] = "other"
    rows = [
        (1, around(items[0][1])),
        (2, around(items[1][1].upper().replace(" ", ", "))),
        (3, around(" ".join(swapped))),
        (4, around(" ".join(items[0][1].split()[:15]))),
        (5, items[3][1]),
        (6, around("nothing")),
        (7, around(items[4][1])),
        (None, around(items[0][1])),
        (8, None),
        (9, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string").selectExpr("*", "1 AS key", "2 AS size")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (5, 3), (7, 4), (None, 0)} and found[1, 0] == 1.0 and 0.8 <= found[3, 2] < 1
    assert decontaminate.find_leaks(edge_docs, bench).count() == 0
    assert decontaminate.find_leaks(edge_docs.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def best_windows(text, item, k):
    """Similarity of the best of all windows of the item's size, and its first hit as a start."""
    w, v = text.split(), item.split()
    grams = lambda x: [" ".join(x[i : i + k]) for i in range(len(x) - k + 1)]
    want, best = Counter(grams(v)), None
    for s in range(max(1, len(w) - len(v) + 1)):
        own = grams(w[s : s + len(v)])
        both = sum((Counter(own) & want).values())
        hit = next((s + i for i, g in enumerate(own) if g in want), None)
        if hit is not None:
            found = (-both / (len(own) + sum(want.values()) - both), max(0, min(hit, len(w) - len(v))))
            best = found if best is None or found < best else best
    return best


def test_no_window_is_more_similar(spark):
    """Texts of few words that repeat, and near copies: every leak that any window shows is found, with its best similarity."""
    rnd, docs, items = random.Random(23), [], []
    for i in range(60):
        words = "ab" if i % 3 == 0 else "abc" if i % 3 == 1 else [f"w{k}" for k in range(40)]
        items.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(6, 16)))))
        for _ in range(3):
            own = items[-1][1].split()
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            around = [[rnd.choice(words) for _ in range(rnd.randint(0, 12))] for _ in range(3)]
            docs.append((len(docs), " ".join([*around[0], *own, *around[1], *(own[rnd.randint(0, 4) :]), *around[2]])))
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in docs:
        for i, x in items:
            k = min(5, len(x.split()))
            if (best := best_windows(t, x, k)) and -best[0] >= 0.8:
                want[d, i] = (round(-best[0], 12), best[1])
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 12), r["start"]) for r in decontaminate.find_leaks(*tables, radius=64).collect()}
    assert got == want and len(want) > 100
    # With the radius of production, leaks are lost only by their fingerprints.
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(*tables).collect()}
    assert near <= want.keys() and len(near) > 0.95 * len(want)


def test_window_fingerprints_and_radius(spark):
    rnd = random.Random(8)
    hashes = [[rnd.getrandbits(64) - (1 << 63) for _ in range(rnd.randint(1, 9))] for _ in range(20)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "i int, h array<long>").select(
        "i", decontaminate.simhash(F.col("h")).alias("fp")
    )
    for r in df.collect():
        h = [x & (1 << 64) - 1 for x in hashes[r["i"]]]
        assert r["fp"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [rnd.getrandbits(64) for _ in range(30)]
    other = []
    for f in fps:
        for _ in range(rnd.randint(0, 40)):
            f ^= 1 << rnd.randrange(64)
        other.append(f)
    pairs = [(i, j, signed(f)) for i, f in enumerate(fps) for j in range(len(other))]
    a = spark.createDataFrame(pairs, "w int, item int, fp long")
    b = spark.createDataFrame([(j, signed(f)) for j, f in enumerate(other)], "item int, item_fp long")
    for radius in (decontaminate.RADIUS, 24, 7):
        got = {(r["w"], r["item"]) for r in decontaminate.within_radius(a, decontaminate.hamming_index(b, radius), radius).collect()}
        assert got == {(i, j) for i, f in enumerate(fps) for j, g in enumerate(other) if (f ^ g).bit_count() <= radius}


def test_radius_leaves_out_no_similar_window(spark):
    """Windows at the smallest similarity from 0.8 on, for items of several sizes: the operator finds what plain shingle counts find."""
    rnd = random.Random(14)
    items, rows = [], []
    for i, n in enumerate([5, 9, 13, 30, 50, 100, 200] * 6):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(4000)}" for _ in range(n)]
        items.append((i, " ".join(words)))
        for changes in range(4):
            w = words[:]
            for at in rnd.sample(range(n), min(n, changes)):
                w[at] = "other"
            end = [f"z{rnd.randrange(9999)}" for _ in range(rnd.randint(0, 30))]
            rows.append((len(rows), " ".join([*end, *w, *end[:5]])))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = set()
    for d, text in rows:
        w = text.split()
        for i, item in items[d // 4 % 42 : d // 4 % 42 + 1]:
            g = grams(item.split())
            n = min(len(item.split()), len(w))
            best = max(sum((x & g).values()) / sum((x | g).values()) for x in (grams(w[s : s + n]) for s in range(len(w) - n + 1)))
            if best >= 0.8:
                want.add((d, i))
    assert found == want and len(want) > 80


def test_license_scan(spark, edge_docs, edge_rows):
    mit = 'MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n'
    rows = [
        (1, mit),
        (2, "text\nReleased under the MIT License.\nmore"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "a license"),
        (5, None),
        (6, "# SPDX-License-Identifier: Apache-2.0"),
        (7, "All rights reserved. Licensed under the Apache License, Version 2.0."),
        (8, "x.\nReleased " + "- " * 800 + "under the MIT License.\ny"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS c", "2 AS t")
    found = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(df).collect()}
    assert found == {
        1: ["MIT"], 2: ["MIT"], 3: ["CC-BY-NC-4.0"], 4: [], 5: [], 6: ["Apache-2.0"], 7: ["Apache-2.0", "all-rights-reserved"], 8: ["MIT"]
    }
    assert all(r["licenses"] == [] for r in license_scan.license_scan(edge_docs).collect())
    assert license_scan.license_scan(edge_docs).count() == len(edge_rows) and license_scan.license_scan(edge_docs.limit(0)).count() == 0


def plain_kernel(s, u):
    from itertools import combinations

    def k(s, u):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(u)), toxicity.ORDER):
                if all(s[i] == u[j] for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + b[-1] - b[0] + 2 - 2 * toxicity.ORDER)
        return total

    return k(s, u) / (k(s, s) * k(u, u)) ** 0.5


def test_standard_notices_by_their_cut_parts(spark):
    gpl = (
        "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
        "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    )
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    notices = [(gpl.format(a, b, v), [f"GPL-{v}.0"]) for v in (2, 3) for a in ";:," for b in ";,"] + [(mpl, ["MPL-2.0"])]
    wrap = lambda text, mark: "\n\n".join("\n".join(mark + line for line in textwrap.wrap(p, 70)) for p in text.split("\n\n"))
    rows = [(i, form, want) for i, (text, want) in enumerate((t, w) for t, w in notices) for form in (text, wrap(text, ""), wrap(text, " * "), "Some words before.\n\n" + text + "\nSome words after.")]
    rows.append((99, gpl.format(";", ";", 2).split("\n\n")[0], []))
    found = license_scan.license_scan(
        spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    ).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {k: want for k, (_, _, want) in enumerate(rows)}


_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission."


@pytest.mark.parametrize(
    "text,want",
    [
        *((_TWO + f"3. Neither the name of {who} nor the names of {whose} contributors {_ENDORSE}\n\nTHIS SOFTWARE IS PROVIDED", ["BSD-3-Clause"]) for who, whose in (
            ("the copyright holder", "its"), ("the University of California, Berkeley", "its"), ("Google Inc.", "its"), ("Foo Co., Ltd.", "its"), ("J. R. Smith", "any"), ("the <organization>", "its"), ("Müller & Söhne", "their"))),
        (_TWO + f"3. The name of the author {_ENDORSE.replace('may be', 'may not be')}", ["BSD-3-Clause"]),
        (_TWO + "3. Neither the name of Google Inc. nor the names of its contributors matter here.", ["BSD-2-Clause"]),
        (_TWO, ["BSD-2-Clause"]),
        ("License: MIT", ["MIT"]),
        ("License: BSD 3-Clause", ["BSD-3-Clause"]),
        ("## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", ["MIT"]),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ("# Distributed under the terms of the Modified BSD License.", ["BSD-3-Clause"]),
        ("The code in this repository is released under the Apache 2.0 license.", ["Apache-2.0"]),
        ("Distributed under GPLv3.", ["GPL-3.0"]),
        ("This library is available under the terms of the GNU Lesser General Public License v2.1.", ["LGPL-2.1"]),
        ("This work is licensed under the Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("All files are licensed under the Mozilla Public License 2.0", ["MPL-2.0"]),
        ("This project is not licensed under the MIT License.", []),
        ("We talked about the MIT License - see the LICENSE file for details.", []),
        ("This project is licensed under the MIT License of our neighbours and some more words.", []),
        ("License: ask us", []),
        ("He studied at MIT under a professor.", []),
        ("the license mitigates it", []),
    ],
)
def test_license_variants(spark, text, want):
    import duckdb

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.license_scan(df).first()["licenses"] == want == plain_licenses(text)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    assert con.sql(license_scan.oracle()).fetchall()[0][1] == want


def with_slots(sentence):
    for slot, form in license_scan.SLOTS:
        if m := re.search(slot, sentence):
            sentence = sentence[: m.start()] + form.replace("{1}", m[1] if m.re.groups else "") + sentence[m.end() :]
    return sentence


def plain_licenses(text):
    """Sentence identifiers and rules by loops: each rule's sentences in order, each with at most its gap of others before it."""
    found = set()
    for cut in (license_scan.LINE_CUT, license_scan.WRAPPED_CUT):
        ids = [with_slots(" ".join(re.findall("[a-z0-9]+", p.lower()))) for p in re.split(cut, text)]

        def ends(at, sentences, gap, ids=ids):
            """Where a match of the rule that begins at `at` may end; the first gap that leads to an end wins, longest first."""
            if at >= len(ids) or ids[at] != sentences[0]:
                return None
            if len(sentences) == 1:
                return at + 1
            return next((e for g in range(gap, -1, -1) if (e := ends(at + 1 + g, sentences[1:], gap)) is not None), None)

        def places(rules, skip=(), ids=ids):
            return [(a, e) for a in range(len(ids)) for r in rules if (e := ends(a, r.sentences, r.gap)) is not None and not any(x < e and a < y for x, y in skip)]

        by_license = {}
        for r in license_scan.RULES:
            by_license.setdefault(r.license, []).append(r)
        for name, rules in by_license.items():
            hidden = [p for by, names in license_scan.HIDES.items() if name in names for p in places(by_license[by])]
            if places(rules, hidden):
                found.add(name)
    return sorted(found)


def test_license_rules_against_plain_loops(spark):
    """Documents of known sentences, parts of notices and other lines in random order; each licence has its turn."""
    rnd = random.Random(11)
    notices = [(n, t) for n, _, t in license_scan.NOTICES] + [(n, t) for n, lines in license_scan.LINES.items() for t in lines]
    rows, wrap = [], lambda t, mark: "\n\n".join("\n".join(mark + line for line in textwrap.wrap(p, 70)) for p in t.split("\n\n"))
    for name, notice in notices:  # each notice alone, wrapped, as a comment, and between other text
        for form in (notice, wrap(notice, ""), wrap(notice, "# "), "Some words.\n\n" + notice + "\n\nMore words."):
            rows.append((form, name))
    pieces = [p for _, t in notices for p in re.split(r"(?<=[.;:])\s+|\n+", t) if p]
    for _ in range(400):
        few = rnd.sample(pieces, 3)
        n = rnd.randint(1, 12)
        rows.append(
            (rnd.choice(["\n", " ", "\n\n"]).join(rnd.choice([*few, "Other words here.", rnd.choice(pieces)]) for _ in range(n)), None)
        )
    bsd2, bsd3 = (next(t for n, t in notices if n == k) for k in ("BSD-2-Clause", "BSD-3-Clause"))
    filler = "\n".join(f"line {i}" for i in range(9))
    rows += [(bsd2 + "\n" + filler + "\n" + bsd3, "BSD-2-Clause"), (bsd3, "BSD-3-Clause")]
    apache = next(t for _, t in notices if t.startswith("Licensed under the Apache License, Version 2.0 ("))
    rows.append((apache.split("; ")[1] + "\n\nYou may obtain a copy of the License at\n\nhttp://example.org/\n\n" + next(t for _, t in notices if "Unless required" in t).split(". ", 1)[1], "Apache-2.0"))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(df).collect()}
    for i, (t, name) in enumerate(rows):
        assert found[i] == plain_licenses(t), t
        assert name is None or name in found[i], (name, t)
    assert found[len(rows) - 2] == ["BSD-3-Clause"]


def test_string_kernel():
    marks = ["^idiot$", "^lowei"]
    strings = ["^idiot$", "^idixot$", "^loweient$", "^abcd$", "^iidiioott$"]
    want = [[plain_kernel(s, u) for u in marks] for s in strings]
    assert np.allclose(toxicity.Kernel(marks)(strings), want, atol=1e-5)
    assert toxicity.joined_letters("m o r o n you a b".split()) == ["moron", "you", "ab"]
    assert toxicity.sentences_of("One two. Three\nfour! five? x") == [["one", "two."], ["three"], ["four!"], ["five?"], ["x"]]
    long = "a" * 10 + "idiot" + "b" * 20
    assert np.allclose(
        toxicity.WordKernel(marks)(["idiot", "ab", long]),
        [
            [plain_kernel("^idiot$", u) ** toxicity.POWER for u in marks],
            [0, 0],
            [max(plain_kernel(w, u) for w in toxicity.windows(long)) ** toxicity.POWER for u in marks],
        ],
        atol=1e-4,
    )


def plain_score(model, text):
    """The score of a text sentence by sentence and word by word."""
    kernel, values, n = toxicity.WordKernel(model.landmarks), [], 0
    for sentence in toxicity.sentences_of(text):
        evidence = [float(kernel([toxicity.letters(w)])[0] @ model.weights) for w in sentence]
        values.append(sum(e for e in evidence if e >= model.floor))
        n += len(sentence)
    values = sorted(values, reverse=True)
    z = np.dot([values[0] if values else 0, sum(values[:3]), np.log1p(n)], model.logistic[:3]) + model.logistic[3]
    return 1 / (1 + np.exp(-z))


def toxic_corpus(rnd, n, insults, share=0.25, per_document=1):
    common = [f"{a}{b}{c}" for a in ("tha", "ner", "sol", "mir") for b in ("te", "lo", "ga") for c in ("n", "rs", "la")]
    out = []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(8, 40))]
        y = rnd.random() < share
        for _ in range(per_document * y):
            words.insert(rnd.randrange(len(words)), insults(rnd))
        out.append((i, ". ".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7)), int(y)))
    return out


def fitted(rows):
    parts = [[toxicity.sentences_of(t) for _, t, y in rows if y == k] for k in (1, 0)]
    return toxicity.fit(*parts)


def test_scorer_against_plain_loops():
    rnd = random.Random(15)
    rows = toxic_corpus(rnd, 200, lambda r: r.choice(["blorfix", "zumquat"]))
    model = fitted(rows)
    texts = [t for _, t, _ in rows[:30]] + ["", None, "\n\n", "b l o r f i x!", "blorfix. blorfix. blorfix. blorfix.", "a.b.c", "12 34"]
    got = toxicity.Scorer(model)(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)
    assert np.allclose([toxicity.Scorer(model)([t])[0] for t in texts], got)


def test_few_labels_and_rare_insults_are_learnt():
    """Nine toxic documents give a model; so does an insult in two of a hundred toxic documents beside frequent ones."""
    rnd = random.Random(16)
    few = toxic_corpus(rnd, 60, lambda r: r.choice(["blorfix", "zumquat", "krandel"]), 0.15, 2)
    model = fitted(few)
    scores = toxicity.Scorer(model)([t for _, t, _ in few])
    assert len(set(np.round(scores, 6))) > 5
    assert scores[[y == 1 for _, _, y in few]].min() > scores[[y == 0 for _, _, y in few]].max()
    rare = toxic_corpus(rnd, 1500, lambda r: "qwelpard" if r.random() < 0.03 else r.choice(["blorfix", "zumquat"]), 0.3)
    model = fitted(rare)
    assert any(m.strip("^$") in "qwelpard" for m in model.landmarks)
    plain = "thaten nerlon solgan mirtela"
    got = toxicity.Scorer(model)(
        [f"{plain} qwelpard {plain}.", f"{plain} qwel-pard {plain}.", f"{plain} blorxfix {plain}.", f"{plain} {plain}."]
    )
    assert got[:3].min() > 0.3 > got[3]


def test_two_words_that_are_toxic_together():
    """Each word stands alone in clean sentences; only both in one sentence are an insult."""
    rnd = random.Random(17)
    common = [f"{a}{b}" for a in ("thaten", "nerlo", "solga", "mirte") for b in ("n", "rs", "la", "mo")]
    rows = []
    for i in range(600):
        y = i % 3 == 0
        sentences = [[rnd.choice(common) for _ in range(7)] for _ in range(4)]
        if y:
            sentences[1][2:4] = ["filthy", "badger"]
        elif i % 3 == 1:
            sentences[0][2], sentences[3][2] = "filthy", "badger"
        rows.append((i, ". ".join(map(" ".join, sentences)) + ".", int(y)))
    model = fitted(rows[:450])
    got = toxicity.Scorer(model)([t for _, t, _ in rows[450:]]) >= toxicity.THRESHOLD
    assert np.mean(got == [y for _, _, y in rows[450:]]) > 0.97


def test_toxicity(spark, edge_docs):
    rnd = random.Random(9)
    common = [f"{a}{b}{c}" for a in ("tha", "ner", "sol", "mir") for b in ("te", "lo", "ga") for c in ("n", "rs", "la")]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(common) for _ in range(rnd.randint(5, 40))]
        if i % 4 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["blorfix", "zumquat"]) + rnd.choice(["", "a", "es"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(common) + " b l o r f i x"), (1003, "blor-fix"), (1004, "blorxfix")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [*labels, (None, 1), (5, None)], "doc_id long, toxic int"
    )
    found = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i, r in found.items() if r["held_out"] and i < 1000]
    assert all(found[i]["predicted"] == (i % 4 == 0) for i in held)
    assert found[1000]["predicted"] == found[1001]["predicted"] == 0 and found[1002]["predicted"] == found[1003]["predicted"] == found[1004]["predicted"] == 1
    assert {r["score"] for r in toxicity.toxicity(edge_docs, lab.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(edge_docs.limit(0), lab).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@driver_tables
def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    guess = {r["doc_id"]: r for r in lang_id.identify(frame, lang_id.learn(frame.where(~held_out()))).collect()}
    kept = [i for i in sorted(docs) if guess[i]["lang_pred"] != "und" and guess[i]["score"] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    first = {}
    for i in kept:
        first.setdefault(docs[i]["text"], i)
    kept = sorted(first.values())
    fps, stay = {i: simhash_dedup.simhash(docs[i]["text"]) for i in kept}, []
    component = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 4:
                old, new = max(component[i], component[j]), min(component[i], component[j])
                component = {k: new if c == old else c for k, c in component.items()}
    stay = [i for i in kept if component[i] == i]
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    stay = [i for i in stay if i not in leaks]
    assert leaks and len(stay) > 0.7 * len(docs)
    check_packed(
        corpus_pipeline.run(spark, SF).collect(), list(zip(stay, library_ids(BYTES, [docs[i]["text"] for i in stay], 0), strict=True))
    )


@driver_tables
def test_stages_on_edge_cases(spark, edge_docs, edge_rows):
    """Nulls, empty and long texts, repeated rows, empty tables, and columns that have the names the stages would like to use."""
    docs = edge_docs.selectExpr("*", "doc_id AS _stage0", "'mine' AS _STAGE1", "'mine' AS _zzz", "'mine' AS _zzz_key")
    texts = {t or "" for _, t in edge_rows}
    exact = corpus_pipeline.exact_duplicates(spark, docs, SF)
    assert sorted(r["text"] or "" for r in exact.collect()) == sorted(texts)
    near = corpus_pipeline.near_duplicates(spark, docs, SF)
    roots = simhash_dedup.fingerprint_components(simhash_dedup.fingerprints(docs)).select("root").distinct().count()
    assert near.count() == roots
    known = corpus_pipeline.language_id(spark, docs, SF)
    lettered = [t for _, t in edge_rows if t and any(map(str.isalpha, t))]
    assert sorted(r["text"] for r in known.collect()) == sorted(lettered)
    clean = corpus_pipeline.benchmark_leaks(spark, docs, SF)
    assert clean.count() == len(edge_rows)
    for stage in (exact, near, known, clean):
        assert stage.columns == docs.columns
        assert all(r["_stage0"] == r["doc_id"] and r["_STAGE1"] == r["_zzz"] == r["_zzz_key"] == "mine" for r in stage.collect())
    check_packed(
        corpus_pipeline.packed(spark, docs, SF).collect(),
        [(i, x) for (i, _), x in zip(edge_rows, library_ids(BYTES, [t for _, t in edge_rows], 0), strict=True)],
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@driver_tables
def test_benchmark_stage_drops_what_holds_an_item(spark, edge_docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"before it {item} after it"), (None, item), (2, "nothing of it"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key")
    assert sorted(r["text"] or "" for r in corpus_pipeline.benchmark_leaks(spark, docs, SF).collect()) == ["", "nothing of it"]


def test_keys_of_an_id_on_many_rows(spark, monkeypatch):
    monkeypatch.setattr(token_store, "_NUMBERS", 7)
    rows = [(None,)] * 50 + [(3,)] * 7 + [(4,)] * 8 + [(5,)]
    got = token_store.all_keys(spark.createDataFrame(rows, "doc_id long")).collect()
    want = [(None, i) for i in range(50)] + [(3, i) for i in range(7)] + [(4, i) for i in range(8)] + [(5, 0)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
