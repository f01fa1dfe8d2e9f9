"""Near duplicates of texts and vectors, and repeated passages, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, documents
from trailmark.llm import common, near, substrings, suffixes, vectors


def lowest(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_clusters():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 30)
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 40))]
        a, b = np.array(pairs).T
        assert common.clusters(n, a, b).tolist() == lowest(n, pairs)


# ---- near -------------------------------------------------------------------------------------


def plain_near(rows):
    docs = {}
    for i, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        docs[i] = sets
    ids = sorted(i for i in docs if i is not None)
    pairs = [
        (x, y) for x, a in enumerate(ids) for y, b in enumerate(ids[:x])
        if docs[a] and docs[b] and 100 * len(docs[a] & docs[b]) >= 75 * len(docs[a] | docs[b])
    ]
    root = lowest(len(ids), pairs)
    return {i: (len(docs[i]), ids[root[k]]) for k, i in enumerate(ids)}


def copies(seed, groups, size):
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(8, 120))]
        for _ in range(rnd.randint(1, size)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(5000)}"
            rows.append((len(rows), " ".join(words), "en"))
    rnd.shuffle(rows)
    return rows


def near_result(spark, rows):
    got = near.similar(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["kept"] == (r["id"] is not None and r["id"] == r["component_id"])
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None}


def test_near_equals_brute_force(spark):
    rows = copies(7, 40, 12)
    assert near_result(spark, rows) == plain_near(rows)


def test_near_with_branching_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 400)
    rows = copies(9, 6, 60)
    assert near_result(spark, rows) == plain_near(rows)


def test_all_blocks_of_a_large_node_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "DEPTH", 1)
    monkeypatch.setattr(near, "NODE_BLOCK", 4)
    rnd, rows = np.random.default_rng(3), []
    for pair in range(30):
        tokens = rnd.integers(0, 1 << 32, near.COORDINATES, dtype=np.uint32)
        for copy in range(2):
            tokens[:20] = rnd.integers(0, 1 << 32, 20, dtype=np.uint32)
            rows.append((2 * pair + copy, bytearray(tokens.tobytes()), [5]))
    classes = spark.createDataFrame(rows, "id long, tokens binary, nodes array<long>")
    got = {r["id"]: r["grp"] for r in near.candidate_groups(classes).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_a_task_holds_two_blocks_of_a_group(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(44)) for _ in range(40)]
    rows = [(i, texts[i // 2] + (" end" if i % 2 else "")) for i in range(80)]  # 40 shingles, or 41
    docs = spark.createDataFrame(rows, "id long, text string")
    members = near.sketches(docs).select("id", "digest", "n_shingles", F.lit(0).cast("long").alias("grp"))
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 400)
    held, hosted = [], common.hosted

    def spy(df, keys, *more):
        if "own" in df.columns:
            held.append(df.groupBy(*keys).agg((F.sum(F.length("own")) / 8).alias("n")).agg(F.max("n")).first()[0])
        return hosted(df, keys, *more)

    monkeypatch.setattr(common, "hosted", spy)
    got = {r["id"]: r["component"] for r in common.components(near.exact_links(docs, members)).collect()}
    assert got == {i: i - i % 2 for i in range(80)}
    assert len(held) > 1 and max(held) < 4 * near.BLOCK_SHINGLES


def test_near_edges(spark):
    assert near_result(spark, ROWS) == plain_near(ROWS)
    assert near.similar(documents(spark, ROWS).filter("false")).count() == 0
    kept = near.keep_one_of_group(spark, documents(spark, ROWS), None)
    # Of the rows that repeat id 7 with equal texts one stays, as of any group.
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_sizes_of_large_and_small_nodes(spark, monkeypatch):
    monkeypatch.setattr(near, "LARGE_NODE", 5)
    rows = [(node, i) for node, n in ((1, 1), (2, 5), (3, 6), (4, 60)) for i in range(n)]
    got = near._with_sizes(spark.createDataFrame(rows, "node long, id long")).select("node", "id", "n").collect()
    sizes = {2: 5, 3: 6, 4: 60}
    assert sorted(map(tuple, got)) == sorted((node, i, sizes[node]) for node, i in rows if node in sizes)


def test_ask_until_one_cluster_is_left():
    asked = []
    links = {0: [1, 2], 1: [0], 2: [0, 3], 3: [2], 4: [5], 5: [4], 6: []}

    def of(i):
        asked.append(i)
        return np.array(links[i], np.int64)

    assert near._clustered(7, np.ones(7), of).tolist() == [0, 0, 0, 0, 4, 4, 6]
    assert len(asked) < 7


# ---- vectors ----------------------------------------------------------------------------------


def plain_vectors(rows):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float)
    links = {k: 0 for k in range(len(rows))}
    pairs = []
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                cosine = good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b]))
                if cosine >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    pairs.append((a, b))
    root = lowest(len(rows), pairs)
    members = {}
    for k in range(len(rows)):
        members.setdefault(root[k], []).append(rows[k][0])
    return sorted(
        (-1 if r[0] is None else r[0], links[k], -1 if r[0] is None else min(m for m in members[root[k]] if m is not None))
        for k, r in enumerate(rows)
    )


def vector_rows(seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            centre = rnd.standard_normal(16)
            for _ in range(rnd.integers(1, 9)):
                rows.append((len(rows), (centre + rnd.standard_normal(16) * rnd.choice([0, 0.1, 0.25, 0.4])).tolist(), label))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (None, rows[0][1], 0),
             (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, [float("inf")] + [1.0] * 15, 1), (n + 6, [1.0], 0), (n + 7, [2.0], 0)]
    return rows + [(n + 8 + k, rows[0][1], 0) for k in range(5)]


@pytest.mark.parametrize("block", [vectors.BLOCK, 8])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    got = vectors.near_vectors(df).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == plain_vectors(rows)
    assert all(r["kept"] == (r["id"] is not None and r["id"] == r["component_id"]) for r in got)


def test_vectors_empty_and_wide(spark):
    empty = spark.createDataFrame([], "id long, vector array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_recall_at_the_threshold(width):
    rnd = np.random.default_rng(99)
    a, b = rnd.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    tables = vectors.tables_needed(64, width, 0.93)
    met = vectors._meets(
        vectors.bucket_codes(a, width, tables), vectors.bucket_codes(0.93 * a + np.sqrt(1 - 0.93**2) * b, width, tables)
    ).any(axis=1)
    assert met.mean() >= 0.999


# ---- passages ---------------------------------------------------------------------------------


def plain_passages(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49) if i is not None else ():
            w = t[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49) if i is not None else ():
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((-1 if i is None else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.choice([30, 49, 50, 51, 200]))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [
            rnd.choice(shared) if rnd.random() < 0.5 else "".join(rnd.choice("xyzé ") for _ in range(rnd.randint(0, 90)))
            for _ in range(rnd.randint(0, 6))
        ]
        rows.append((i, "".join(parts), "en"))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 900, "bucket_bytes": 2000, "shard_bytes": 3000, "array_bytes": 500}])
def test_passages_equal_brute_force(spark, sizes):
    short = [(i, None if t is None else t[:3000], lang) for i, t, lang in ROWS]
    rows = [*passages(4), *[(None if i is None else 1000 + i, t, lang) for i, t, lang in short], (2000, "ab" * 400, "en"), (2001, "ba" * 300, "en")]
    got = substrings.without_repeats(documents(spark, rows), **sizes).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain_passages(rows)
    if not sizes:
        assert substrings.without_repeats(documents(spark, rows).filter("false")).count() == 0


def common_passage():
    """900 texts, of which a third hold one passage with other text at both its ends."""
    rnd = random.Random(8)

    def text(n):
        return "".join(rnd.choice("abcdefghij klmnopq") for _ in range(n))

    passage = text(400)
    return [(i, f"{text(150)}{passage if i % 3 == 0 else text(100)}{text(150)}", "en") for i in range(900)]


def test_a_passage_in_a_third_of_all_texts(spark):
    rows = common_passage()
    got = substrings.without_repeats(documents(spark, rows), block_bytes=20_000, bucket_bytes=60_000, array_bytes=3_000).collect()
    assert sorted(tuple(r) for r in got) == plain_passages(rows)


def test_a_hot_hash_is_split():
    """No hash keeps more than a few segments, none of more than two windows, and equal windows keep one hash."""
    texts = [t.encode() for _, t, _ in common_passage()]

    def block(hot):
        return substrings._Block(list(range(len(texts))), [len(t) for t in texts],
                                 substrings.zstandard.compress(b"".join(texts)), hot)

    def segments(b):
        kinds = {}
        for start, windows, key in zip(b.start.tolist(), b.windows.tolist(), b.key.tolist()):
            kinds.setdefault(key, set()).add(b.text[start : start + windows + 49])
        return kinds

    whole = block(np.empty(0, np.uint64))
    hot = np.sort(np.array([k for k, v in segments(whole).items() if len(v) > 35], np.uint64))
    assert len(hot) and max(map(len, segments(whole).values())) > 250
    parts = block(hot)
    assert max(map(len, segments(parts).values())) <= 35
    assert parts.split.any() and parts.windows[parts.split].max() <= 2
    assert parts.windows.sum() == whole.windows.sum()
    key_of = {}
    for start, windows, key in zip(parts.start.tolist(), parts.windows.tolist(), parts.key.tolist()):
        for k in range(start, start + windows):
            assert key_of.setdefault(parts.text[k : k + 50], key) == key
    # Digests tell apart what is different, and nothing else.
    assert len(set(zip(parts.key.tolist(), parts.digests().tolist()))) == sum(map(len, segments(parts).values()))


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_arrays(symbols):
    s = [*symbols, 0]
    order = sorted(range(len(s)), key=lambda i: s[i:])
    a = np.array(s, np.int64)
    if len(s) > 2:
        assert suffixes._by_bucket(a, max(s) + 1).tolist() == order
        assert suffixes._one_by_one(s, max(s) + 1) == order

    def prefix(i, j):
        k = 0
        while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        return k

    assert suffixes.common_prefixes(a, np.array(order)).tolist() == [0, *[prefix(x, y) for x, y in zip(order, order[1:])]]
