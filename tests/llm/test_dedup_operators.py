"""Exact dedup, sharding, SimHash groups and line dedup against brute force on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from echotrace.llm import components, exact_dedup, line_dedup, sharding, simhash_dedup


def groups_of(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return by


def check_exact(found, rows, largest):
    by, kept = groups_of(rows), Counter()
    assert len(found) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in found:
        ids = by[sha[r["text_sha256"]]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["doc_id"] in ids
        assert r["keep_id"] == ((max if largest else min)(known) if known else None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert set(kept.values()) <= {1} and len(kept) == len(by)


def test_exact_dedup(edge_docs, edge_rows):
    check_exact(exact_dedup.exact_dedup(edge_docs, "largest").collect(), edge_rows, True)
    check_exact(exact_dedup.exact_dedup(edge_docs.repartition(11), "smallest", fan_in=3).collect(), edge_rows, False)
    assert exact_dedup.exact_dedup(edge_docs.limit(0)).count() == 0


def test_runs_merge_two_by_two(spark):
    """Every number of runs ends in one entry for each key, and rounds that share an exchange need no other."""
    for runs in (1, 2, 3, 4, 5, 8, 13, 33):
        rows = spark.range(200).selectExpr(f"cast(id % {runs} as int) AS run", "id % 17 AS digest", "concat('x', id % 17) AS body", "id AS stay", "1L AS n")
        aggs = [F.max("stay").alias("stay"), F.sum("n").alias("n")]
        found = exact_dedup.merged_runs(rows.groupBy("run", "digest", "body").agg(*aggs), ["digest", "body"], aggs, runs)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["digest"], r["stay"], r["n"]) for r in found.collect()) == [(d, max(range(d, 200, 17)), len(range(d, 200, 17))) for d in range(17)]
    assert plan.count("Exchange hashpartitioning") == 1 + 3  # that of the entries, and one for two of the six rounds


def test_exact_dedup_with_colliding_digests(edge_docs, edge_rows):
    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)  # a sixteenth of all texts share a digest
    check_exact(exact_dedup.exact_dedup(edge_docs.select("doc_id", "text", "n"), "largest", digest=weak).collect(), edge_rows, True)


def test_permutation(spark):
    for n in (1, 2, 3, 5, 17, 100, 101, 1000):
        image = sharding.permuted(spark.range(n), "id", n, "y").collect()
        assert sorted(r["y"] for r in image) == list(range(n))


def plain_image(x, n):
    """The permutation in plain Python."""
    a = max(1, int((max(n - 1, 0)) ** 0.5) + 1)
    b = max(1, -(-n // a))
    keys, p = sharding.round_keys(), sharding.PRIME

    def mixed(v, key):
        y = (v * sharding.MULTIPLIER + key) % p
        y = ((y ^ (y >> 15)) * 69621 + key) % p
        return y

    while True:
        left, right = divmod(x, b)
        for k, key in enumerate(keys):
            if k % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        x = left * b + right
        if x < n:
            return x


def test_sharding(edge_docs, edge_rows):
    rows = sharding.feistel_shards(edge_docs).collect()
    assert len(rows) == len(edge_rows) and sorted(r["row_number"] for r in rows) == list(range(len(rows)))
    ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in rows:
        x = plain_image(r["row_number"], len(rows))
        assert (r["shard"], r["slot"]) == (x % 16, x // 16)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.feistel_shards(edge_docs.limit(0)).count() == 0


def plain_simhash(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def linked(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(edge_docs, edge_rows):
    rows = simhash_dedup.simhash_groups(edge_docs).collect()
    fps = [plain_simhash(t) for _, t in edge_rows]
    roots, least = linked(fps), {}
    for (i, _), r in zip(edge_rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(edge_rows, fps, roots, strict=True))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash_dedup.simhash_groups(edge_docs.limit(0)).count() == 0


def test_links_of_a_dense_group_in_small_blocks(spark):
    rnd = random.Random(2)
    seed = rnd.getrandbits(64)
    fps = {seed}
    for _ in range(400):
        x = rnd.choice(sorted(fps)) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    mine = defaultdict(set)
    for f, r in zip(fps, linked(fps), strict=True):
        mine[r].add(int(np.uint64(f).view(np.int64)))
    for block, positions in ((20, None), (20, 2), (4096, 3), (50, 4)):
        roots = components.components(simhash_dedup.link_forest(df, block, positions)).collect()
        got = {r["node"]: r["root"] for r in roots}
        theirs = defaultdict(set)
        for f in fps:
            s = int(np.uint64(f).view(np.int64))
            theirs[got.get(s, s)].add(s)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_counted_links_and_stars():
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rnd.choice(fps)
        for _ in range(rnd.randint(1, 6)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    cell = np.arange(len(fps)) // 90
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if cell[i] == cell[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert set(zip(*(x.tolist() for x in simhash_dedup.counted_links(fps, cell)), strict=True)) == want
    one = np.zeros(len(fps), dtype=np.int64)
    few = simhash_dedup.stars(len(fps), *simhash_dedup.counted_links(fps, one))
    assert (few == simhash_dedup.crowded_stars(fps)).all()
    assert [simhash_dedup.positions_of(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 28, 1 << 29, 1 << 37)] == [1, 1, 2, 2, 3, 4]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


ASCII_WHITE = " \t\n\r\f\v"


def plain_hash(piece):
    """The polynomial of the bytes, mixed, by its definition."""
    h = sum(x * pow(line_dedup.BASE, i, 1 << 64) for i, x in enumerate(piece.encode())) % (1 << 64)
    return mixed(h)


def mixed(h):
    h = (h ^ (h >> 32)) * line_dedup.MIX % (1 << 64)
    return h ^ (h >> 29)


def plain_lines(text):
    lines, at = [], 0
    for line in (text or "").split("\n"):
        if bare := line.strip(ASCII_WHITE):
            start = at + line.index(bare)
            lines.append((start, start + len(bare)))
        at += len(line) + 1
    return lines


def plain_runs(text):
    """(start, end) of each chunk and of every two neighbouring lines."""
    lines = plain_lines(text)
    return set(plain_chunks(text)) | {(a[0], b[1]) for a, b in zip(lines, lines[1:], strict=False)}


def plain_chunks(text):
    """(start, end) of each chunk of at least two lines, line by line."""
    lines = plain_lines(text)
    out, begin, before, marked_before = [], 0, None, False
    for i, (s, e) in enumerate(lines):
        h = plain_hash(text[s:e])
        marked = mixed((h + (before or 0) * line_dedup.BASE) % (1 << 64)) % line_dedup.MODULUS == 0
        if (marked and not marked_before and i) or i == len(lines) - 1:
            if i > begin:
                out.append((lines[begin][0], e))
            begin = i + 1
        before, marked_before = h, marked
    return out


def plain_windows(text, words):
    """(start, end) of the shortest runs of units with so many words from each unit to both sides."""
    units, at = [], 0
    for m in re.finditer(r"[^ \t\n\r\f\v]+", text or ""):
        gap = text[at : m.start()]
        if not units or "\n" in gap or text[at - 1] in ".!?":
            units.append([m.start(), m.end(), 1])
        else:
            units[-1][1:] = [m.end(), units[-1][2] + 1]
        at = m.end()
    out = set()
    for i in range(len(units)):
        for step in (1, -1):
            j, n = i, units[i][2]
            while n < words and 0 <= j + step < len(units):
                j += step
                n += units[j][2]
            if n >= words:
                out.add((units[min(i, j)][0], units[max(i, j)][1]))
    return out


def plain_spans(rows, hashes, passage):
    """Repeated spans by key, each but the first of its text; a span that meets its first place is cut to what lies beyond."""
    seen, gone = defaultdict(set), defaultdict(set)
    for i, t in set(rows):
        for s, e in plain_runs(t) | (plain_windows(t, passage) if passage else set()):
            seen[t[s:e]].add(((i is not None, i or 0), hashes[i, t], s, e, t))
    for places in seen.values():
        (first_key, first_hash, first, end, _), *others = sorted(places)
        for key, h, s, e, t in others:
            gone[key[1] if key[0] else None, t].add((end if (key, h) == (first_key, first_hash) and s < end else s, e))
    return gone


def cut_away(text, spans):
    """The characters that aren't white space and lie in no span."""
    kept = [c for k, c in enumerate(text) if not any(s <= k < e for s, e in spans)]
    return "".join(c for c in kept if c not in ASCII_WHITE)


def text_hashes(df):
    return {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}


def test_chunks_and_windows_against_brute_force():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "bb.", "c!", "dé", "日本", "x?y"])
    texts = ["", " ", "\n\n", "one", "a b\n", "\n a b \n\t\n c. d\n"]
    texts += ["".join(word() + rnd.choice([" ", "  ", "\n", " \n\n ", "\t", "\r\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts.append(("".join(f"w{rnd.randrange(99)} " for _ in range(40)) + "\n") * 700)  # over a block of the prefix sums
    owner, start, length, h = line_dedup.spans_of(pa.array(texts), 7)
    found, hashes = defaultdict(set), {}
    for i, s, n, x in zip(owner.tolist(), start.tolist(), length.tolist(), h.tolist(), strict=True):
        found[i].add((s, s + n))
        assert hashes.setdefault(texts[i][s : s + n], x) == x
    assert len(set(hashes.values())) == len(hashes)
    for i, t in enumerate(texts[:-1]):
        assert found[i] == plain_runs(t) | plain_windows(t, 7)
        assert all(hashes[t[s:e]] % (1 << 64) == plain_hash(t[s:e]) for s, e in found[i])
    assert found[len(texts) - 1] == plain_runs(texts[-1]) | plain_windows(texts[-1], 7)


def test_seeds_of_shared_windows_are_shared():
    """Every window to the right holds a seed, which follows from the window alone."""
    rnd = random.Random(13)
    unit = lambda: " ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 5, 12]))) + "."
    texts = ["\n".join(unit() for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    passage = "\n".join(unit() for _ in range(8))
    texts += ["\n".join([unit(), unit(), passage, unit()]) for _ in range(10)]
    words = line_dedup.words_of(pa.array(texts))
    _, c, d = words.seeds(10)
    owners, starts, ends = words.owner[c], words.start[c], words.end[d]
    data = "".join(texts).encode()
    found = defaultdict(list)
    for i, s, e in zip(owners.tolist(), starts.tolist(), ends.tolist(), strict=True):
        found[i].append(data[s:e].decode())
    for i, t in enumerate(texts):
        units, want = t.split("\n") if t else [], set()
        for a in range(len(units)):
            n, b = len(units[a].split()), a
            while n < 10 and b + 1 < len(units):
                b += 1
                n += len(units[b].split())
            if n >= 10:
                pairs = ["\n".join(units[k : k + 2]) for k in range(a, b)] or [units[a]]
                want.add(min(pairs, key=plain_hash))
        assert set(found[i]) == want
    assert set.intersection(*(set(found[i]) for i in range(40, 50)))
    # Spans are left out only if their text has no seed or chunk that another has.
    owner, h = line_dedup.seeds_of(pa.array(texts), 10)
    times = Counter(h.tolist())
    again = np.array([x for x, n in times.items() if n > 1])
    whole, some = (set(zip(*(x.tolist() for x in line_dedup.spans_of(pa.array(texts), 10, r)), strict=True)) for r in (None, again))
    spans = Counter(x[3] for x in whole)
    assert some <= whole and all(x in some for x in whole if spans[x[3]] > 1)


def test_chunks_come_back_after_an_insertion():
    rnd = random.Random(3)
    lines = [" ".join(f"w{rnd.randrange(500)}" for _ in range(8)) for _ in range(60)]
    text = "\n".join(lines)
    other = "\n".join(["a new line", *lines[:20], "another new line in between", *lines[20:]])
    shared = {text[s:e] for s, e in plain_chunks(text)} & {other[s:e] for s, e in plain_chunks(other)}
    assert len(shared) > 0.6 * len(plain_chunks(text))


def test_line_dedup(spark, edge_docs, edge_rows):
    rnd = random.Random(4)
    line = lambda n=9: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    passage, menu = "\n".join(line() for _ in range(12)), "\n".join(line(1) for _ in range(40))
    paragraph = " ".join(f"p{rnd.randrange(900)}" for _ in range(55)) + "."
    rows = [(i, "\n".join([line(), line(), [passage, menu, paragraph][i % 3], line(), line()])) for i in range(100, 112)] + [
        r for r in edge_rows if len(r[1] or "") < 10_000
    ]
    rows += [(200, "x y\n" * 9 + line(60)), (201, "\n".join([line(), "x y\nx y\nx y", line()]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = text_hashes(df)
    for how in (None, line_dedup.PASSAGE):
        gone = plain_spans(rows, hashes, how)
        want = Counter((i, cut_away(t or "", gone[i, t])) for i, t in rows)
        got = line_dedup.line_dedup(df, how).collect()
        assert Counter((r["doc_id"], "".join(c for c in r["text"] or "" if c not in ASCII_WHITE)) for r in got) == want
        olds = defaultdict(list)
        for i, t in rows:
            olds[i].append(t)
        for r in got:
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
            assert any(len(r["text"] or "") + r["removed_chars"] == len(t or "") for t in olds[r["doc_id"]])
            assert (r["removed_chunks"] > 0) == (r["removed_lines"] > 0) == (r["removed_chars"] > 0)
        whole = [r for r in got if r["doc_id"] in range(101, 112) and r["doc_id"] % 3 == 2]
        if how:  # the paragraph is one line
            assert sorted(r["removed_lines"] for r in whole) == [0, 1, 1, 1]
    assert line_dedup.line_dedup(edge_docs).count() == len(edge_rows)
    assert line_dedup.line_dedup(edge_docs.limit(0)).count() == 0


def test_repeated_chunks_of_short_lines_go(spark):
    """40 lines of a few words in two documents: all of the second place goes."""
    rnd = random.Random(12)
    for n in (1, 2, 3, 4, 6):
        passage = [" ".join(f"m{rnd.randrange(10**6)}" for _ in range(n)) for _ in range(40)]
        rows = [(i, "\n".join([f"top {n} {i}", *passage, f"bottom {n} {i}"])) for i in (1, 2)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        chunks = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(df, None).collect()}
        both = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(df).collect()}
        assert chunks == both == {1: 0, 2: 40}


def test_short_passages_are_found_at_every_size(spark):
    """Passages of a few short lines between other lines, by a measure that knows neither chunks nor pairs: the share of their lines that goes."""
    rnd, rows, places = random.Random(22), [], {}
    line = lambda: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(4))
    for n in (2, 3, 4, 6, 8, 12):
        for _ in range(20):
            passage = [line() for _ in range(n)]
            for copy in range(2):
                own = [[line() for _ in range(rnd.randint(1, 6))] for _ in range(2)]
                places[len(rows)] = (n, copy, passage, own)
                rows.append((len(rows), "\n".join([*own[0], *passage, *own[1]])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, (_, copy, passage, own) in places.items():
        assert got[i].split("\n") == [*own[0], *([] if copy else passage), *own[1]]


def _passage_rows(rnd, passage, joint, copies=6):
    """The passage between unlike lines (joint a line break) or inside one long line (a space)."""
    other = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(8)) + "."
    return [joint.join([other(), other(), other(), passage, other(), other(), other()]) for _ in range(copies)]


def test_passages_are_found_wherever_they_begin_and_end(spark):
    rnd, rows, passages = random.Random(8), [], []
    unit = lambda n: " ".join(f"p{rnd.randrange(10**6)}" for _ in range(n)) + "."
    for sizes in [(55,), (20, 20, 20), (15, 15, 15, 15), (11,) * 5, (10,) * 6, (60, 5), (5, 60), (49, 1)]:
        for joint in "\n ":
            passages.append(joint.join(map(unit, sizes)))
            rows += [(len(rows) + i, t) for i, t in enumerate(_passage_rows(rnd, passages[-1], joint))]
    short = unit(30)
    rows += [(len(rows) + i, t) for i, t in enumerate(_passage_rows(rnd, short, "\n"))]
    found = {
        r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    }
    whole = dict(rows)
    for k, p in enumerate(passages):
        assert found[6 * k]["text"] == whole[6 * k]
        for i in range(6 * k + 1, 6 * k + 6):
            s = whole[i].index(p)
            assert found[i]["text"] == whole[i][:s] + whole[i][s + len(p) + 1 :] and found[i]["removed_chunks"] == 1
    assert all(found[i]["text"] == t for i, t in rows[-6:])  # one line under 50 words: stays


def test_passages_of_edge_rows(spark, edge_docs, edge_rows):
    got = line_dedup.line_dedup(edge_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in edge_rows)
    base = dict(edge_rows)[0]
    assert all(r["text"] == (base if r["doc_id"] == 0 else "") for r in got if r["doc_id"] in (0, 20, 21))
    assert line_dedup.line_dedup(edge_docs.limit(0)).count() == 0
    loop = "\n".join(["same words"] * 500)
    one = line_dedup.line_dedup(spark.createDataFrame([(1, loop)], "doc_id long, text string")).collect()[0]
    assert one["text"].split() == ["same", "words"] * 2  # what lies beyond the first pair


def test_short_lines_and_ends_of_paragraphs_are_part_of_a_passage(spark):
    rnd, rows, passages = random.Random(9), [], []
    word = lambda: f"q{rnd.randrange(10**6)}"
    passages += [
        "\n".join(word() for _ in range(60)), "\n".join(f"{word()} {word()}" for _ in range(30)), "\t".join(word() for _ in range(60))
    ]
    passages += [" ".join(" ".join(word() for _ in range(n)) + "." for n in sizes) for sizes in ((30, 20, 9), (52, 3), (18, 18, 18, 4), (20, 20, 20, 20, 7))]
    for p in passages:
        rows += [(len(rows) + i, t) for i, t in enumerate(_passage_rows(rnd, p, "\n", 3))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    for i, t in rows:
        p = passages[i // 3]
        assert got[i] == (t if i % 3 == 0 else t.replace(p + "\n", ""))
