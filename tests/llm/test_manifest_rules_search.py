"""Host-level rules, the Merkle manifest and the document scan against plain models."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.edge import ROWS, WORDS, documents
from trailmark.llm import common, hosts, manifest, scan


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- hosts ------------------------------------------------------------------------------------


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(inside),
    }


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c\x85 é|#<😀", max_size=60))
def test_measures_equal_plain_count(text):
    assert dict(zip(hosts.MEASURES, hosts.measure(text))) == plain_measures(text)


def test_measures_of_every_kind_of_row(spark):
    got = hosts.judged(documents(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    texts = {i: t for i, t, _ in ROWS if i is not None}
    for r in got:
        if r["id"] is not None:
            plain = plain_measures(texts[r["id"]])
            assert {m: r[m] for m in hosts.MEASURES} == plain
            failed = plain["n_words"] < 50 or 100 * plain["n_repeat_words"] > 50 * plain["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed) and not r["host_rejected"]


def test_prior_by_moments():
    # Rates 0.2 and 0.4 of 1,000 documents each: p = 0.3, sample variance 0.02.
    a, b = hosts.prior(2, 2000, 600, 200_000 + 400_000, 200_000**2 + 400_000**2, 2000)
    spread = (0.02 / 0.21 - 0.001) / 0.999
    assert math.isclose(a + b, 1 / spread - 1) and math.isclose(a / (a + b), 0.3)
    # Hosts that vary no more than chance, one host, no failure, no document.
    assert sum(hosts.prior(2, 4, 2, 1_000_000, 2 * 500_000**2, 1_000_000)) == hosts.MOST_WEIGHT
    assert sum(hosts.prior(1, 9, 3, 333_333, 333_333**2, 111_111)) == hosts.MOST_WEIGHT
    assert hosts.prior(3, 9, 0, 0, 0, 333_333)[0] == 0
    assert hosts.prior(0, 0, 0, 0, 0, 0) == (hosts.LEAST_WEIGHT, hosts.LEAST_WEIGHT)


def test_host_verdicts_reach_documents(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(WORDS) + str(rnd.randrange(900)) for _ in range(80))
    rows = [(100 + i, good(), "bad" if i < 4 else "good") for i in range(60)]
    rows += [(200 + i, "short text", "bad") for i in range(40)]  # 40 of 44 fail
    rows += [(300, "short", "once"), (301, good(), "fresh"), (302, good(), None), (303, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["id"]: r for r in hosts.judged(docs).collect()}
    assert {i for i, r in got.items() if r["host_rejected"]} >= {*range(100, 104), *range(200, 240)}
    assert not any(got[i]["kept"] for i in (*range(100, 104), 300, 303))
    assert all(got[i]["kept"] for i in (*range(104, 160), 301, 302))
    counts = hosts.failures(hosts.measured(docs))
    a, b = hosts.priors(counts)["few_words"]
    for r in hosts.host_verdicts(counts).collect():
        failed = sum(s == r["host"] and len(t.split()) < 50 for _, t, s in rows)
        assert math.isclose(r["few_words_rate"], (failed + a) / (r["n"] + a + b))
    assert hosts.judged(docs.limit(0)).count() == 0


# ---- manifest ---------------------------------------------------------------------------------


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_levels(ground):
    levels = [ground]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H("".join(low[i : i + 8])) for i in range(0, len(low), 8)])
    return levels


def plain_manifest(rows):
    """Sorted result rows of (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for doc_id, source, lang, n, text in rows:
        leaf = H("".join(map(plain_field, (doc_id, source, lang, n, text))))
        altered = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            low = None if text is None else text.translate(str.maketrans(common.UPPER, common.LOWER))
            altered = H("".join(map(plain_field, (doc_id, source, lang, n, low))))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, altered))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: r[:3])
        lower[lang] = plain_levels([r[2] for r in trees[lang]])
    upper = plain_levels([lower[lang][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, (known, doc_id, leaf, altered) in enumerate(trees[lang]):
            siblings, node = [], altered or leaf
            for levels, place in ((lower[lang], i), (upper, at)):
                for level in levels[:-1]:
                    run = place // 8 * 8
                    group = level[run : run + 8]
                    siblings += group[: place - run] + group[place - run + 1 :]
                    group[place - run] = node
                    node, place = H("".join(group)), place // 8
            root = upper[-1][0]
            out.append((doc_id if known else None, leaf, lower[lang][-1][0], root, H("".join(siblings)), node, node == root))
    return sorted(out, key=str)


def found_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_of_every_kind_of_row(spark):
    docs = documents(spark, [*ROWS, (14, "Ä B", "")])
    rows = [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]
    got = found_rows(manifest.verified(docs))
    assert got == plain_manifest([(i, s, lang, n, t) for i, s, lang, n, t in rows])
    assert {r[6] for r in got} == {True, False}
    assert manifest.verified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("langs, size", [(1, 1), (1, 8), (1, 9), (3, 65), (11, 140), (70, 100)])
def test_manifest_of_many_sizes(spark, langs, size):
    rnd = random.Random(size)
    rows = [(i, f"s{i % 3}", f"l{rnd.randrange(langs):02}", i, f"Text {i}") for i in rnd.sample(range(10_000), size)]
    rows += [(20_000 + i, None, "zz", None, "HOT") for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    expected = plain_manifest(rows)
    whole = manifest.Manifest(docs)
    for block in (8, 64, manifest.BLOCK):
        proofs = whole.proofs(block).withColumn("verified", F.col("folded_root") == F.col("root"))
        assert found_rows(proofs) == expected


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 700), st.data())
def test_missing_nodes_are_the_minimal_union(n, data):
    known = sorted(data.draw(st.sets(st.integers(0, n - 1), min_size=1, max_size=20)))
    levels = plain_levels([H(str(i)) for i in range(n)])
    needed, derivable, places = set(), set(), set(known)
    for level, nodes in enumerate(levels[:-1]):
        derivable |= {(level, i) for i in places}
        for i in places:
            needed |= {(level, k) for k in range(i // 8 * 8, min(len(nodes), i // 8 * 8 + 8))}
        places = {i // 8 for i in places}
    got = {(level, int(i)) for level, found in manifest.missing(np.array(known), n) for i in found}
    assert got == needed - derivable
    beside, root = manifest.derive({i: levels[0][i] for i in known}, n, {(a, b): levels[a][b] for a, b in got})
    assert root == levels[-1][0] and len(beside) == len(levels) - 1


def test_a_changed_node_is_noticed(spark):
    rows = [(i, None, "en", i, f"t{i}") for i in range(20)]
    whole = manifest.Manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    forged = F.when((F.col("tree") == "=en") & (F.col("level") == 1) & (F.col("idx") == 1), F.lit(H("forged"))).otherwise(F.col("h"))
    whole.nodes = common.cut(whole.nodes.withColumn("h", forged))
    got = {r["id"]: r["folded_root"] == r["root"] for r in whole.proofs(8).collect()}
    assert not any(got[i] for i in range(8)) and not any(got[i] for i in range(16, 20))


# ---- scan -------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))


def plain_ranked(docs, items, k):
    texts = [(i, Counter(plain_terms(t))) for i, t in docs]
    N = sum(bool(c) for _, c in texts)
    L = sum(sum(c.values()) for _, c in texts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(plain_terms(text))
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, words in asked.items():
        found = []
        for i, c in texts:
            score = 0
            for t in words:
                if t in c:
                    m = 100 - 25 + 25 * sum(c.values()) * N // L
                    w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (0, "The quick, brown FOX and the quick dog"), (1, None), (2, ""), (3, "nosuchterm ...!"), (4, "é日本😀 word"), (5, "Alpha12 beta12 alpha12"),
    (6, "a" * 30000), (6, "owls"), (None, "near town"), (7, "12345"),
]


@pytest.mark.parametrize("most", [scan.BLOCK_BYTES, 60])
@pytest.mark.parametrize("k", [20, 2])
def test_ranks_equal_brute_force(spark, most, k):
    rows = ROWS + [(50 + i, " ".join(WORDS[i % 7 :]), "en") for i in range(30)]  # equal scores
    docs = documents(spark, rows)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    got = scan.ranked(docs, items, k, most=most)
    assert sorted((tuple(r) for r in got.select("item", "rank", "id", "score").collect()), key=str) == plain_ranked(
        [(i, t) for i, t, _ in rows], ITEMS, k
    )
    assert scan.ranked(docs, items.limit(0)).count() == 0
    assert scan.ranked(docs.limit(0), items).count() == 0


def test_item_blocks_are_whole_and_bounded(spark):
    items = spark.createDataFrame([(i, f"one two three w{i}") for i in range(40)], "item_id long, text string")
    asked = scan.item_terms(items)
    blocks = list(scan.item_blocks(asked, 300))
    assert len(blocks) > 10
    seen = Counter(i for b in blocks for i in set(b.column("item").to_pylist()))
    assert set(seen.values()) == {1} and len(seen) == 40
    for b in blocks:
        size = sum(len(t) + 16 for t in b.column("term").to_pylist())
        assert size <= 300 or len(set(b.column("item").to_pylist())) == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBé0 _-,\x00\x7f日", max_size=40))
def test_automaton_finds_whole_terms(text):
    words = ["a", "ab", "b", "é", "0a", "日"]
    data = scan.folded(text)
    found = Counter(words[v] for _, v in scan.automaton(words).iter(data.decode("latin-1")))
    plain = Counter(plain_terms(text))
    assert found == Counter({w: plain[w] for w in words if plain[w]})
    assert scan.term_count(data) == sum(plain.values()) and scan.terms(text) == plain_terms(text)


def test_best_rows_per_item():
    rows = pa.table({"item": [1, 1, 1, 0, 0], "score": [5, 7, 7, 1, 1], "id": [3, 9, 2, None, 4]})
    assert scan.best_of(rows, 2).to_pylist() == [
        {"item": 0, "score": 1, "id": None}, {"item": 0, "score": 1, "id": 4},
        {"item": 1, "score": 7, "id": 2}, {"item": 1, "score": 7, "id": 9},
    ]
