"""The operators against brute force, public libraries, SQL or held-out accuracy."""

import base64
import collections
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselar.llm import bpe, exact, fingerprint, hosts, kernel, lines, links, minhash, mixing, quality, shards, shared, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def near(spark):
    """Sixty texts, some of them with exact and near copies (every twentieth word replaced)."""
    r, rows, i = random.Random(9), [], 0
    for seed in range(60):
        text = prose(seed + 100, 60 + 10 * (seed % 9))
        rows.append((i, text))
        i += 1
        for c in range(seed % 4):
            words = text.split(" ")
            for k in range(r.randrange(20), len(words), 20):
                words[k] = f"w{r.randrange(10**6)}"
            rows.append((i, text if c == 2 else " ".join(words)))
            i += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_minhash_against_brute_force(spark, near):
    sets = {}
    for i, t in near:
        h, first = kernel.words(pa.array([t]))
        sets[i] = set(kernel.grams(h, first, minhash.SHINGLE)[0].tolist())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sure = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= minhash.AT_LEAST]
    for a, b in sure:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.keep_id for r in minhash.groups(frame(spark, near)).collect()}
    of = lambda i: got.get(i, i)
    assert sum(of(a) == of(b) for a, b in sure) >= 0.9 * len(sure) > 50
    wrong = [(a, b) for a in sets for b in sets if a < b and of(a) == of(b) and root(a) != root(b)]
    assert not wrong


def brute_words(text):
    """The words of a text by its characters."""
    out, word = [], ""
    for c in text + " ":
        cp = ord(c)
        single = 0x3100 <= cp <= 0x9FFF or 0x3040 <= cp < 0x3100 or 0x0E00 <= cp < 0x0E80 or 0x20000 <= cp < 0x30000
        mark = cp < 0x80 and not c.isalnum() or 0x80 <= cp < 0xC0 and c not in "ª²³µ¹º¼½¾" or 0x2000 <= cp < 0x2080 or 0x3000 <= cp < 0x3040
        mark = mark or 0xFF01 <= cp < 0xFF10 or 0xFF1A <= cp < 0xFF21 or 0xFF3B <= cp < 0xFF41 or 0xFF5B <= cp < 0xFF66
        if single or mark:
            out += [word] if word else []
            out += [c] if single else []
            word = ""
        else:
            word += c.lower() if cp < 0x80 else c
    return out


def test_words_against_characters():
    r = random.Random(17)
    signs = "aB9 .,é«»“”—…ß½漢字かなカ、。！Ａสวัส한글😀𠀀\u00a0\u3000\n"
    texts = ["", "«Bonjour» “hi”", "漢字かな。漢字", "สวัสดี", "x" * 50] + ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(400)]
    h, first = kernel.words(pa.array(texts))
    names: dict[int, str] = {}
    for i, t in enumerate(texts):
        own, want = h[first[i] : first[i + 1]].tolist(), brute_words(t)
        assert len(own) == len(want), (t, want)
        assert all(names.setdefault(x, w) == w for x, w in zip(own, want))
    assert len(set(names.values())) == len(names)


def test_near_copies_in_scripts_without_blanks(spark):
    r = random.Random(3)
    text = "".join(r.choice("漢字文書類似検索言語学習資料大小中") for _ in range(200))
    docs = [(1, text), (2, text[:90] + "異" + text[91:]), (3, "".join(r.choice("赤青黄緑白黒紫橙灰茶金銀") for _ in range(200)))]
    assert [tuple(x) for x in minhash.groups(frame(spark, docs)).collect()] == [(2, 1)]


def test_b_bit_estimate():
    r, k = np.random.default_rng(1), 4096
    multiply, mask = minhash.permutations(k)
    for overlap in (0, 200, 600, 1000):
        common, mine, theirs = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (overlap, 1000 - overlap, 1000 - overlap))
        low = np.stack([minhash.minima(np.concatenate([common, x]), multiply, mask).astype(np.uint8) for x in (mine, theirs)])
        true = overlap / (2000 - overlap)
        for bits in (1, 2, 4):
            assert minhash.similarity(minhash.packed(low, bits), 0, np.array([1]), k, bits)[0] == pytest.approx(true, abs=0.06)


def test_forest_connects_what_all_pairs_connect():
    r = random.Random(3)
    for _ in range(30):
        n = r.randint(1, 25)
        s = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                s[i, j] = s[j, i] = r.random()
        edges = links.forest(s, n, lambda d, i, js: d[i, js], 0.9)
        assert len(edges) < n

        def components(pairs):
            up = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    up[i] = up[j] = min(up[i], up[j])
            return up

        assert components([(i, j) for i, j, _ in edges]) == components([(i, j) for i in range(n) for j in range(n) if s[i, j] >= 0.9])


def test_a_hot_key_is_never_in_one_group(spark):
    """A key of 20,000 nodes: every two of them meet, in groups of two blocks at most; small keys stay whole."""
    keys = spark.range(20_000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("doc_id"))
    keys = keys.unionByName(spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "key long, doc_id long"))
    shared_ = links.shared_keys(keys)
    assert {(r.key, r.n) for r in shared_.select("key", "n").distinct().collect()} == {(7, 20_000), (1, 2)}
    groups = links.in_blocks(shared_, 4000).groupBy("key", "low", "high").agg(F.count("*").alias("n"), F.collect_set("node").alias("nodes")).collect()
    large = [r for r in groups if r.key == 7]
    assert len(large) == 10 and max(r.n for r in large) < 8800 and [(r.low, r.high, sorted(r.nodes)) for r in groups if r.key == 1] == [(0, 0, [5, 6])]
    r = random.Random(1)
    assert all(any(a in g.nodes and b in g.nodes for g in large) for a, b in (r.sample(range(20_000), 2) for _ in range(20)))


def test_of_keys_that_the_same_nodes_have_one_is_enough(spark):
    sets = {1: {5, 6}, 2: {6, 5}, 3: {5, 6, 7}, 4: {5, 7}, 9: {5, 7}, 8: {7, 6, 5}}
    rows = spark.createDataFrame([(k, d) for k, s in sets.items() for d in s], "key long, doc_id long").repartition(3)
    got = {}
    for r in links.distinct_groups(links.shared_keys(rows)).collect():
        got.setdefault(r.key, set()).add(r.doc_id)
        assert r.n == len(sets[r.key])
    assert got == {k: sets[k] for k in (1, 3, 4)}


def test_blocks_of_a_large_key_connect_what_one_task_would(spark):
    """Forty nodes share one key and are alike if their numbers are near; blocks of 3 give the components of all pairs."""
    r = random.Random(5)
    values = sorted(r.sample(range(400), 40))
    keys = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 5), (2, 20), (3, 6)], "key long, doc_id long").repartition(3)
    payload = spark.createDataFrame([(i, 1000 + i, values[i].to_bytes(8, "little")) for i in range(40)], "node long, rep long, data binary")
    load = lambda p: np.array([int.from_bytes(x, "little") for x in p.to_pylist()])
    compare = lambda d, i, js: (np.abs(d[js] - d[i]) <= 12).astype(float)
    found = [{(x.a, x.b) for x in links.linked(keys, payload, load, compare, 1.0, block=b).collect()} for b in (1 << 14, 3)]

    def parts(edges):
        up = {i: i for i in range(1000, 1040)}
        for _ in range(40):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    every = {(1000 + i, 1000 + j) for i in range(40) for j in range(i) if abs(values[i] - values[j]) <= 12}
    assert parts(found[0]) == parts(found[1]) == parts(every) and len(set(parts(every).values())) > 2


def test_beyond_what_may_be_broadcast(spark):
    """The branches of tables that don't fit a broadcast give the rows of those that do."""
    rows = spark.createDataFrame([(i % 7 if i < 60 else None, i) for i in range(70)], "k long, x long")
    keys = spark.createDataFrame([(1,), (3,), (9,)], "k long")
    for f in (shared.in_keys, shared.without_keys):
        small, large = (sorted(f(rows, F.col("k"), keys, max_bytes=m).collect(), key=str) for m in (1 << 20, 0))
        assert small == large and small
    groups = spark.createDataFrame([(1, 9, "a"), (2, 8, "b"), (3, 2, "c")], "k long, n long, v string")
    want = sorted(shared.keyed(rows, groups, ["k"]).collect())
    for most, hot in ((0, 5), (96, 5), (0, 100)):
        assert sorted(shared.keyed(rows, groups, ["k"], max_bytes=most, hot=hot).collect()) == want and len(want) == 27


def test_repeats_of_an_identifier(spark):
    """Repeated rows cost a row each; an identifier with different texts has the links of all of them."""
    a, b = prose(71, 120), prose(72, 120)
    near = a.replace(a.split()[5], "other", 1)
    rows = [(5, a)] * 200 + [(9, b)] * 3 + [(7, near), (7, b), (3, prose(73, 80)), (11, b)]
    want = {(7, 5), (9, 5), (11, 5)}
    for _ in range(2):
        docs = frame(spark, rows)
        assert {tuple(r) for r in minhash.groups(docs).collect()} == want
    keys = minhash.sketches(frame(spark, rows))
    nodes, copies, counts = links.collapse(keys)
    assert (nodes.count(), counts.count(), copies.count()) == (4, 2, 205)
    got = [sorted(fingerprint.fingerprint(frame(spark, rows)).select("doc_id", "linked_id", "score").distinct().collect()) for _ in range(2)]
    assert got[0] == got[1] and {r.doc_id: r.linked_id for r in got[0]} == {3: None, 5: 7, 7: 9, 9: 7, 11: 7}


def test_equal_digests_of_different_texts(spark, monkeypatch):
    """With a digest that tells nothing apart, only the bytes decide."""
    monkeypatch.setattr(exact, "digests", lambda text: (F.length(text).cast("long"), F.lit(1).cast("long")))
    docs = frame(spark, [(4, "ab"), (2, "cd"), (3, "ab"), (5, "cd"), (6, "xyz"), (7, "xyz"), (7, "xyz"), (8, "q")])
    assert sorted(map(tuple, exact.find(docs).collect())) == [(4, 3), (5, 2), (7, 6), (7, 6)]
    assert sorted(map(tuple, exact.dedup(docs).collect())) == [(2, "cd"), (3, "ab"), (6, "xyz"), (8, "q")]


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    pool = ["".join(r.choice("abcde ") for _ in range(r.choice([1, 3, 11, 12, 20, 24, 25, 40]))) for _ in range(40)]

    def edited(s):
        k, kind = r.randrange(len(s)), r.randrange(4)
        return [s, s[:k] + "z" + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + "z" + s[k:]][kind]

    docs = [(i, "\n".join(edited(r.choice(pool)) for _ in range(r.randint(0, 6)))) for i in range(60)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    occurrences = [((i, k), x) for i, t in docs for k, x in enumerate(t.split("\n")) if x.strip()]
    first = {}
    for p, x in occurrences:
        first.setdefault(x, p)
    # Below NEAR_CHARS only an equal line counts.
    near = lambda x, y: x == y or min(len(x), len(y)) >= lines.NEAR_CHARS and abs(len(x) - len(y)) <= 1
    keep = {x: min((q, d) for y, q in first.items() if near(x, y) and (d := distance(x, y)) <= 1) for x in first}
    want = {(*p, *keep[x][0], keep[x][1]) for p, x in occurrences if keep[x][0] != p}
    got = {tuple(x) for x in lines.find(frame(spark, docs)).collect()}
    assert got == want and any(x[4] for x in want)


def test_short_lines_go_when_they_repeat(spark):
    docs = [(0, "Les.\nAll rights reserved.\n\n  \nQue."), (1, "Les.\nAll right reserved.\n\n  \nQui."), (2, "x\nQui.\nWith, to to."), (3, "With to to.\nx")]
    got = {tuple(x) for x in lines.find(frame(spark, docs)).collect()}
    assert got == {(1, 0, 0, 0, 0), (1, 1, 0, 1, 1), (2, 1, 1, 4, 0), (3, 1, 2, 0, 0)}


def test_deletion_variants():
    assert len(lines.variants("abc")) == 4 and len(lines.variants("aab")) == 3
    shared = lambda a, b, k: set(lines.variants(a, k).tolist()) & set(lines.variants(b, k).tolist())
    assert shared("kitten", "kiten", 1) and shared("kitten", "mitten", 1) and not shared("kitten", "sittin", 1) and shared("kitten", "sittin", 2)


def test_bpe_against_a_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    vocab = bpe.vocabulary(bpe.PATH)
    theirs = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=vocab.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["", " ", "don't 'll  x", "　日本語 ½²", "=" * 300, "<|endoftext|>"] + ["".join(r.choice(" \n\tab'sé1½.-日'relvmd") for _ in range(50)) for _ in range(800)]
    encoder = bpe.Encoder(vocab, store_words=100)
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        tokens, ends = encoder.encode(*kernel.buffers(pa.array(part)))
        for i, t in enumerate(part):
            own = tokens[ends[i] : ends[i + 1]]
            assert own.tolist() == theirs.encode_ordinary(t) == encoder.exactly(t.encode()) and encoder.decode(own).tobytes() == t.encode()
    with pytest.raises(ValueError):
        bpe.Vocabulary({base64.b64decode("YQ=="): 0})


def test_lsm_index_against_a_dictionary():
    r = np.random.default_rng(5)
    for most in (1, 3, 16, 1000):
        index, want = exact.Index(most, 2), collections.defaultdict(list)
        for _ in range(20):
            a, b, ids = r.integers(0, 40, 9), r.integers(0, 2, 9), r.integers(0, 999, 9)
            index.add(a, b, ids)
            for x in zip(a.tolist(), b.tolist(), ids.tolist()):
                want[x[:2]].append(x[2])
        got = {(int(x["a"]), int(x["b"])): (int(x["id"]), int(x["n"])) for rows in index.repeated() for x in rows}
        assert got == {k: (min(v), len(v)) for k, v in want.items() if len(v) > 1}
        least, n = index.lookup(np.array([0, 77]), np.array([0, 0]))
        assert n.tolist() == [len(want[0, 0]), 0] and least[0] == min(want[0, 0])
        assert len(index.compact()) == len([k for k in want if want[k]])


def brute_features(text, rank):
    x = np.frombuffer(text.encode(), np.uint8)
    n = len(x) - 63
    if n < 64:
        return []
    level = []
    for i in range(n):
        c = np.bincount(x[i : i + 64])
        c = c[c > 0]
        level.append(int((fingerprint._PART[64] - fingerprint._PART[c].sum()) * 1000 // fingerprint._PART[64]))
    points = collections.Counter()
    for i in range(n - 63):
        points[min(range(i, i + 64), key=lambda j: (rank[level[j]], j))] += 1
    return sorted(j for j, p in points.items() if p >= fingerprint.MIN_POINTS)


def test_fingerprint_features_against_brute_force(near):
    texts = [t for _, t in near[:6]] + ["", "short", "é" * 70]
    rank = fingerprint.ranks(np.random.default_rng(0).integers(0, 99, 1001))
    offs, data = kernel.buffers(pa.array(texts))
    h, doc = fingerprint.features(offs, data, rank)
    assert [int((doc == i).sum()) for i in range(len(texts))] == [len(brute_features(t, rank)) for t in texts]


def test_fingerprint_links_against_brute_force(spark, near):
    got = fingerprint.fingerprint(frame(spark, near)).collect()
    d = fingerprint.Digests([base64.b64decode(r.digest) for r in sorted(got, key=lambda r: r.doc_id)])
    pairs = {(i, j) for i in range(len(near)) for j in np.flatnonzero(fingerprint.compare(d, i, np.arange(len(near))) >= fingerprint.AT_LEAST).tolist() if i < j}
    linked = {r.doc_id for r in got if r.linked_id is not None}
    assert len(pairs) > 10 and sum(i in linked and j in linked for i, j in pairs) >= 0.9 * len(pairs)
    assert all((min(r.doc_id, r.linked_id), max(r.doc_id, r.linked_id)) in pairs or r.score == 100 for r in got if r.linked_id is not None)


def test_fingerprint_links_short_texts(spark):
    """Short texts that are near copies by their word pairs are linked, equal ones without a window too, and others aren't."""
    r, rows = random.Random(4), [(0, "one"), (1, "one"), (2, ""), (3, ""), (4, "two")]
    for seed in range(40):
        words = prose(5000 + seed, 5 + seed).split()
        rows.append((10 + 2 * seed, " ".join(words)))
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((11 + 2 * seed, " ".join(words)))
    got = {x.doc_id: x for x in fingerprint.fingerprint(frame(spark, rows)).collect()}
    assert (got[1].linked_id, got[1].score, got[2].linked_id, got[4].linked_id) == (0, 100, 3, None)
    pairs = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows[5:]}
    alike = [(i, i + 1) for i in range(10, 90, 2) if jaccard(pairs[i], pairs[i + 1]) >= 0.6]
    few = [p for p in alike if min(got[i].n_features for i in p) < fingerprint.MIN_FEATURES]
    assert len(few) >= 20 and sum(got[a].linked_id == b for a, b in few) >= 0.9 * len(few)
    assert all(jaccard(pairs[i], pairs[got[i].linked_id]) >= 0.2 for i in pairs if got[i].linked_id is not None)


def test_fingerprint_leaves_out_no_link(spark, near):
    """Numbers of links, best partners and classes are those of all pairs, passages of long texts and short texts among them."""
    r, long, rows = random.Random(8), prose(900, 3000), list(near)
    rows += [(1000, long), *[(1001 + k, long[700 * k : 700 * k + 420 + 40 * k]) for k in range(12)]]
    for k in range(30):
        words = prose(7000 + k // 3, 40).split()
        words[r.randrange(40)] = f"w{k}"
        rows.append((2000 + k, " ".join(words)))
    got = {x.doc_id: x for x in fingerprint.fingerprint(frame(spark, rows)).collect()}
    ids = sorted(got)
    d = fingerprint.Digests([base64.b64decode(got[i].digest) for i in ids])
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    scores = np.stack([fingerprint.compare(d, i, np.arange(len(ids))) for i in range(len(ids))])
    assert (scores == scores.T).all()
    for i, s in zip(ids, scores):
        equal = {j for j in ids if got[j].digest == got[i].digest and j != i}
        alike = {j: x for j, x in zip(ids, s.tolist()) if x >= fingerprint.AT_LEAST and got[j].digest != got[i].digest}
        assert got[i].n_links == len({got[j].digest for j in alike})
        partners = alike | dict.fromkeys(equal, 100.0)
        if partners:
            x, j = max((x, -j) for j, x in partners.items())
            assert (got[i].linked_id, got[i].score) == (-j, pytest.approx(x, abs=1e-4))
        else:
            assert got[i].linked_id is None
        for j in partners:
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: got[i].class_id for i in ids} == {i: root(i) for i in ids}
    # A passage has few of the long text's features, so a key of several of them would miss it.
    assert sum(got[1001 + k].n_links > 0 for k in range(12)) >= 10 and any(got[i].n_features < fingerprint.MIN_FEATURES and got[i].n_links for i in ids)


def test_fingerprint_pairs_never_leave_their_task(spark):
    """Forty texts that are alike have 780 links; what is moved of them grows with the texts."""
    rows = [(i, prose(1, 300) + " " + prose(8000 + i, 40)) for i in range(40)]
    nodes, _, _ = links.collapse(fingerprint.digests(frame(spark, rows)).drop("packed"))
    got = fingerprint._by_features(nodes, fingerprint.AT_LEAST).collect()
    total = collections.Counter()
    for x in got:
        total[x.rep] += x.n
    assert total == dict.fromkeys(range(40), 39) and len(got) < 400


@pytest.mark.parametrize("block", [1 << 12, 3])
def test_all_links_against_brute_force(spark, block):
    """Every two of forty nodes that share a key count once, however many keys they share and blocks they meet in."""
    r = random.Random(6)
    values = [r.randrange(100) for _ in range(40)]
    reps = [1000 + i // 2 if i < 4 else 1000 + i for i in range(40)]
    sets = {1: set(range(0, 25)), 2: set(range(15, 40)), 3: {3, 7, 9, 20}, 4: {3, 7, 9, 21}, 5: set(range(0, 40, 3)), 6: {0, 1, 39}}
    keys = spark.createDataFrame([(k, i) for k, own in sets.items() for i in own], "key long, doc_id long").repartition(3)
    payload = spark.createDataFrame([(i, reps[i], values[i].to_bytes(8, "little")) for i in range(40)], "node long, rep long, data binary")
    load = lambda p: np.array([int.from_bytes(x, "little") for x in p.to_pylist()])
    compare = lambda d, i, js: 1.0 - np.abs(d[js] - d[i]) / 100
    got = links.all_links(keys, payload, load, compare, 0.9, block=block).collect()
    up = {x: x for x in reps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in got:
        if x.n == 0:
            up[max(root(x.rep), root(x.other))] = min(root(x.rep), root(x.other))
    partners = {i: {} for i in range(40)}
    for i in range(40):
        for j in range(40):
            if reps[i] != reps[j] and any(i in own and j in own for own in sets.values()) and 1.0 - abs(values[i] - values[j]) / 100 >= 0.9:
                partners[i][j] = 1.0 - abs(values[i] - values[j]) / 100
    for i, own in partners.items():
        rows = [x for x in got if x.node == i and x.n > 0]
        assert sum(x.n for x in rows) == len(own) and all(x.rep == reps[i] for x in rows)
        if own:
            assert max((x.score, -x.other) for x in rows) == max((x, -reps[j]) for j, x in own.items())
        assert all(root(reps[i]) == root(reps[j]) for j in own)
    whole = {x: x for x in reps}
    for _ in range(40):
        for i, own in partners.items():
            for j in own:
                whole[reps[i]] = whole[reps[j]] = min(whole[reps[i]], whole[reps[j]])
    assert {x: root(x) for x in reps} == whole


def test_fewest_common_features():
    """Of filters with fewer features in common than `fewest` says none scores so much."""
    r, least, at_least = np.random.default_rng(3), fingerprint.fewest(30.0), 30.0
    for _ in range(2000):
        n, m = r.integers(6, 161, 2)
        a, b = r.integers(0, 2**63, n, dtype=np.uint64), r.integers(0, 2**63, m, dtype=np.uint64)
        common = int(r.integers(0, min(n, m) + 1))
        b[:common] = a[:common]
        d = fingerprint.Digests([fingerprint.digest(a), fingerprint.digest(b)])
        if fingerprint.compare(d, 0, np.array([1]))[0] >= at_least:
            assert common >= least[d.on[0], d.on[1]]
    assert least[650, 650] > 20 and (least == least.T).all()


def test_shards_keep_links_and_sizes(spark, near):
    docs = frame(spark, near)
    got = shards.assign(docs, shards=5)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    own = shards.cut(docs, got).first()
    by_hash = shards.cut(docs, docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("shard"))).first()
    assert own.weight == by_hash.weight and own.cut_weight < 0.5 * by_hash.cut_weight


def test_votes_against_brute_force(spark):
    r = random.Random(12)
    docs = {i: {f"line {r.randrange(12)}" for _ in range(r.randint(1, 4))} for i in range(40)}
    at = {i: r.randrange(4) for i in docs}
    links_ = shards.shared_lines(frame(spark, [(i, "\n".join(x)) for i, x in docs.items()]))
    labels = spark.createDataFrame(list(at.items()), "doc_id long, shard int")
    got = {x.doc_id: (x.shard, x.best, round(x.gain, 6)) for x in shards.propose(links_, labels, F.lit(True), 4).collect()}
    want = {}
    for i, mine in docs.items():
        votes = [0.0] * 4
        for x in mine:
            others = [j for j, y in docs.items() if x in y]
            for j in others:
                if j != i:
                    votes[at[j]] += 1 / (len(others) - 1)
        best = max(range(4), key=lambda s: (round(votes[s], 9), s == at[i], -s))
        if best != at[i] and votes[best] - votes[at[i]] > 1e-9:
            want[i] = (at[i], best, round(votes[best] - votes[at[i]], 6))
    assert got == want and len(want) > 5


def test_who_is_within_a_quota(spark):
    r = random.Random(13)
    rows = [(i, r.randrange(3), r.randrange(4), r.randrange(5)) for i in range(200)]
    quota = {0: 17, 1: 0, 2: 1000}
    df = spark.createDataFrame(rows, "doc_id long, shard int, bin long, digest long").repartition(3)
    got = {x.doc_id for x in shards._within(df, ["shard"], spark.createDataFrame(list(quota.items()), "shard int, most long")).collect()}
    want = {x[0] for s, q in quota.items() for x in sorted((x for x in rows if x[1] == s), key=lambda x: (x[2], x[3], x[0]))[:q]}
    assert got == want


def test_short_lines_link_documents(spark):
    docs = frame(spark, [(0, "Les.\n\n  "), (1, "Les.\n\n  "), (2, "other\n\n  ")])
    assert sorted((r.doc_id, r.n) for r in shards.shared_lines(docs).collect()) == [(0, 2), (1, 2)]


def test_shard_quotas():
    assert shards.quotas({(0, 1): 5, (1, 0): 3}, [10, 10], 11) == {(0, 1): 4, (1, 0): 3}
    assert sum(shards.targets(10, [5, 0, 0])) == 10 and shards.targets(10, [4, 0, 0])[0] == 4


def test_oracles(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for module in (exact, mixing, hosts, lines):
        df = module.query(spark, sf_dir)
        want = con.sql(module.ORACLE_SQL)
        order = [df.columns.index(c) for c in want.columns]
        assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr), module.__name__


def test_mixing_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), f"s{r.randrange(3)}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets, budget = {"s0": 1.0, "s1": 5.0}, 3000
    got = {x.doc_id: x.copies for x in mixing.sample(docs, targets=targets, budget=budget).collect()}
    keys = {x.doc_id: (x.mix_key, x.doc_id) for x in mixing.prepared(docs).collect()}
    want = {}
    for s, share in (("s0", 1 / 6), ("s1", 5 / 6)):
        own = sorted((d for d in rows if d[2] == s), key=lambda d: keys[d[0]])
        total, quota = sum(len(d[1].split()) for d in own), math.floor(budget * share)
        rest, used = quota % total, 0
        for d in own:
            used += len(d[1].split())
            want[d[0]] = quota // total + (used <= rest and rest > 0)
    assert got == {i: n for i, n in want.items() if n}


def texts_of_two_kinds(n, seed):
    r, out = random.Random(seed), []
    for i in range(n):
        y = int(r.random() < 0.3)
        words = prose(1000 + seed * n + i, 60).split(" ")
        for k in range(0, 60, 12) if y else ():
            words[k] = r.choice(["vile", "rotten", "nasty", "foul"])
        out.append((i, " ".join(words), y))
    return out


def test_held_out_accuracy(spark):
    train, held = texts_of_two_kinds(300, 1), texts_of_two_kinds(200, 2)
    docs, labels = (spark.createDataFrame([r[:2] for r in train], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in train], "doc_id long, toxic int, quality int"))
    other, truth = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string"), {r[0]: r[2] for r in held}
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(other, model).collect()}
    assert np.mean([got[i].toxic == bool(y) for i, y in truth.items()]) >= 0.95
    assert (np.diff(model.thresholds) >= 0).all() and all(0 <= r.severity <= len(model.thresholds) for r in got.values())
    good = {r.doc_id: r.keep for r in quality.score(other, quality.fit(docs, labels)).collect()}
    assert np.mean([good[i] == (y == 0) for i, y in truth.items()]) >= 0.95


def test_ordinal_likelihood_and_optimum():
    """Gradients and curvature against differences of the likelihood as it is defined; the fit against other points."""
    r = np.random.default_rng(1)
    n, d, k = 120, 4, 3
    x, grade, weight = r.standard_normal((n, d)), np.append(r.integers(0, k + 1, n - 4), np.arange(4)), r.random(n) + 0.1
    weight /= weight.sum()
    s = lambda v: 1 / (1 + np.exp(-v))

    def value(w, theta):
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        z = x @ w
        return -(weight * np.log(s(edges[grade + 1] - z) - s(edges[grade] - z))).sum()

    w0, t0, e = r.standard_normal(d), np.array([-1.0, 0.2, 1.5]), 1e-5
    got, by_z, by_theta, hessian = toxicity.likelihood(x @ w0, t0, grade, weight)
    assert got == pytest.approx(value(w0, t0))
    unit = np.eye(max(d, k)) * e
    assert by_z @ x == pytest.approx([(value(w0 + u[:d], t0) - value(w0 - u[:d], t0)) / (2 * e) for u in unit], abs=1e-6)
    assert by_theta == pytest.approx([(value(w0, t0 + u[:k]) - value(w0, t0 - u[:k])) / (2 * e) for u in unit[:k]], abs=1e-6)
    other = lambda t: toxicity.likelihood(x @ w0, t, grade, weight)[2]
    assert hessian == pytest.approx(np.array([(other(t0 + u[:k]) - other(t0 - u[:k])) / (2 * e) for u in unit[:k]]), abs=1e-6)

    l1 = 0.01
    doc, at = np.repeat(np.arange(n), d), np.tile(np.arange(d), n)
    w, theta = toxicity.ordinal_fit(doc, at, x.ravel(), grade, weight, d, l1=l1, rounds=2000)
    best = value(w, theta) + l1 * np.abs(w).sum()
    for size in (1e-3, 0.05, 0.5):
        for move in size * r.standard_normal((200, d + k)):
            t = theta + move[d:]
            if (np.diff(t) > 0).all():
                assert best <= value(w + move[:d], t) + l1 * np.abs(w + move[:d]).sum() + 1e-9


def test_fits_take_as_many_jobs_whatever_the_partitions(spark):
    train = texts_of_two_kinds(80, 3)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in train], "doc_id long, toxic int, quality int")
    sc, jobs = spark.sparkContext, {}
    for parts in (4, 40):
        for module in (toxicity, quality):
            sc.setJobGroup(f"{module.__name__}-{parts}", "")
            module.fit(docs.repartition(parts), labels)
            jobs[module, parts] = len(sc.statusTracker().getJobIdsForGroup(f"{module.__name__}-{parts}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert all(jobs[m, 4] == jobs[m, 40] > 0 for m in (toxicity, quality))


def test_ratio_scaling_and_score_against_brute_force():
    """Log-count ratios, unit length and the score of the quality model, from dictionaries."""
    r = random.Random(21)
    rows = [np.array(sorted(r.sample(range(50), 12)), np.uint32) for _ in range(60)]
    y = np.array([float(int(x[0]) % 2) for x in rows])
    model = quality.fit_rows(rows, y, blend=0.0)
    good, bad = collections.Counter(), collections.Counter()
    for x, t in zip(rows, y):
        (good if t else bad).update(x.tolist())
    size = [sum(c.values()) + (1 << quality.BITS) for c in (good, bad)]
    ratio = {b: math.log((good[b] + 1) / size[0]) - math.log((bad[b] + 1) / size[1]) if good[b] + bad[b] >= 3 else 0.0 for b in range(50)}
    assert model.square[:50] == pytest.approx([ratio[b] ** 2 for b in range(50)], rel=1e-5)
    scaled = [{b: ratio[b] / math.sqrt(sum(ratio[c] ** 2 for c in x.tolist())) for b in x.tolist()} for x in rows]
    w = {b: model.weight[b] / ratio[b] if ratio[b] else 0.0 for b in range(50)}
    margins = [sum(w[b] * v for b, v in x.items()) + model.bias for x in scaled]
    assert np.mean([(m > 0) == (t > 0) for m, t in zip(margins, y)]) > 0.9
    text = pa.array(["one two two", "", "one"])
    bucket, doc = quality.features(text)
    whole = quality.NbsvmModel(np.arange(1 << quality.BITS) % 7 - 3.0, np.arange(1 << quality.BITS) % 5 + 1.0, 0.5)
    for i, got in enumerate(whole.score(text)):
        own = bucket[doc == i]
        norm = math.sqrt(sum(whole.square[b] for b in own)) or 1e-6
        assert got == pytest.approx(sum(whole.weight[b] for b in own) / norm + 0.5)


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    x, y = r.standard_normal((60, 4)), np.sign(r.standard_normal(60))
    at, first, cost = np.tile(np.arange(4), 60), np.arange(0, 241, 4), np.full(60, 0.5)
    w, b = quality.dual_coordinate_descent(first, at, x.ravel(), y, cost, 4, epochs=400)
    value = lambda w, b: (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = value(w, b)
    assert all(best <= value(w + d[:4], b + d[4]) + 1e-3 for d in 0.05 * r.standard_normal((300, 5)))


def test_host_reputation_falls_with_bad_pages(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 2}.com/{i}") for i in range(80)] + [(200, "http://new.site1.com/"), (201, "http://other.net/")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    o = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "page_id long, good int")
    got = {r.page_id: r for r in hosts.decide(p, o).collect()}
    assert got[0].keep and not got[1].keep and got[201].keep
    assert got[1].posterior_mean < got[200].posterior_mean < got[0].posterior_mean
    assert got[1].upper_bound >= got[1].posterior_mean


def test_hosts_that_fall_against_sql(spark):
    """A table in which good and bad hosts share domains and suffixes: keep is both, and SQL gives the same rows."""
    r, pages, outcomes = random.Random(31), [], []
    for h in range(30):
        rate = 0.05 if h % 5 == 0 else 0.95
        host = f"{'www.' if h % 2 else ''}h{h}.site{h % 7}.{('com', 'co.uk', 'org')[h % 3]}" if h % 10 else f"10.0.0.{h}"
        for k in range(r.randint(1, 40)):
            pages.append((len(pages), f"https://{host}/{k}"))
            if r.random() < 0.8:
                outcomes.append((len(pages) - 1, int(r.random() < rate)))
    pages += [(len(pages), None), (len(pages) + 1, "https://h1.site1.co.uk./x"), (len(pages) + 2, "http://[::1]:80/"), (0, pages[0][1])]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.sql("CREATE TABLE told (page_id BIGINT, good BIGINT)")
    con.executemany("INSERT INTO told VALUES (?, ?)", outcomes)
    df = hosts.decide(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good long"))
    want = con.sql(hosts.sql("known AS (SELECT * FROM told)"))
    got = [tuple(x[c] for c in want.columns) for x in df.collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    keep = [x[want.columns.index("keep")] for x in got]
    assert 20 < keep.count(False) < len(keep) - 20


def test_suffix_rules_and_addresses(spark, tmp_path):
    (tmp_path / "list").write_text("// comment\ncom\nuk\nco.uk\n*.ck\n!www.ck\na.b.net\nрф\n\n")
    rules = hosts.read_suffixes(str(tmp_path / "list"))
    assert rules == ("com", "uk", "co.uk", "*.ck", "!www.ck", "a.b.net", "рф", "xn--p1ai")
    want = {
        "x.y.com": ("com", "y.com"), "y.co.uk": ("co.uk", "y.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.uk": ("uk", "x.uk"), "p.q.r.ck": ("r.ck", "q.r.ck"), "www.ck": ("ck", "www.ck"),
        "s.www.ck": ("ck", "www.ck"), "z.y.a.b.net": ("a.b.net", "y.a.b.net"), "b.net": ("net", "b.net"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = {x.h: (x.s, x.d) for x in df.select("h", hosts.suffix_of(F.col("h"), rules).alias("s"), hosts.domain_of(F.col("h"), rules).alias("d")).collect()}
    assert got == want
    urls = {"http://a.b/fr/825?page=2": 825, "https://a.b/25#top": 25, "http://a.b/853/": 853, "http://a.b/x9": None, "http://a.b/": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {x.u: x.n for x in df.select("u", hosts.document_of(F.col("u")).alias("n")).collect()} == urls


def test_the_mixed_rows_arent_shuffled(spark):
    """Whole rows meet their source's plan without an exchange above them, and get the rows of a plan too large for that."""
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string").repartition(3).checkpoint()
    mixed = mixing.mix(docs)
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "RepartitionByExpression" not in plan
    p = mixing.plan(mixing.prepared(docs)).checkpoint()
    small, large = (sorted(map(tuple, mixing.by_source(docs, "source", p, max_bytes=m).collect()), key=str) for m in (1 << 20, 0))
    assert small == large and len(small) == 60


def test_pipeline_against_brute_force(spark, tmp_path):
    """Toxic texts go, one of each group of copies stays, what is left is mixed to its budget and tokenised."""
    import corpus_pipeline

    two = texts_of_two_kinds(240, 5)
    rows = [(i, t + f"\nid{i}", "en", f"s{i % 3}", len(t)) for i, t, _ in two]
    near = [(1000 + i, rows[i][1].replace(rows[i][1].split()[7], "changed", 1), "en", "s9", 1) for i in range(0, 40, 2)]
    same = [(2000 + i, rows[i][1], "en", "s9", 1) for i in range(1, 40, 2)]
    spark.createDataFrame(rows + near + same, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 - y, y) for i, _, y in two], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in rows + near + same}
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    clean = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.toxic}
    shingles = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i in clean for w in [text[i].lower().replace(".", " ").split()]}
    kept = []
    for i in sorted(clean):
        if not any(jaccard(shingles[i], shingles[j]) > 0.6 for j in kept):
            kept.append(i)
    source = {r[0]: r[3] for r in rows + near + same}
    left = spark.createDataFrame([(i, text[i], source[i]) for i in kept], "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.sample(left).collect()}
    assert dict(collections.Counter(r.doc_id for r in out)) == want and len(clean) < len(text) - 40
    vocab = bpe.vocabulary(bpe.PATH)
    assert all(b"".join(vocab.bytes[t] for t in r.tokens).decode() == text[r.doc_id] and r.round_trip for r in out)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
