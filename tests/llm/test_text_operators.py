"""Language ID, exact dedup, BPE and packing against plain models."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edge import ROWS, documents, write
from trailmark.llm import bpe, exact, language, packing


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- language ---------------------------------------------------------------------------------


def plain_profile(texts, size):
    counts = {}
    for text in texts:
        word = []
        for c in text.lower() + " ":
            if c.isalpha():
                word.append(c)
                continue
            marked = "_" + "".join(word) + "_"
            if word:
                for n in (1, 2, 3):
                    for i in range(len(marked) - n + 1):
                        g = marked[i : i + n]
                        if g != "_":
                            counts[g] = counts.get(g, 0) + 1
            word = []
    # Neighbouring words share one mark: no difference to the n-grams.
    def code(g):
        value = 0
        for c in g:
            value = value << 21 | ord(c)
        return value

    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_language_equals_plain_rank_order(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog ate, the end!", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"),
         ("there is nothing other than that", None), ("und der Mond", "de"), ("Où est le chat", None), ("zzz", None)] * 3
    )]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 20
    learned = language.profiles(docs.select("lang", "text"), size)
    profiles = {lang: plain_profile([t for _, t, g in rows if g == lang], size) for lang in ("de", "en", "fr")}
    got = {}
    for r in learned.collect():
        got.setdefault(r["lang"], {})[r["rank"]] = r["gram"]
    for lang, grams in profiles.items():
        assert len(got[lang]) == len(grams)
    for r in language.identify(docs, learned, size).select("text", "lang_pred", "score").collect():
        own = plain_profile([r["text"]], size)
        apart = {
            lang: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(apart, key=lambda k: (apart[k], k))
        assert (r["lang_pred"], pytest.approx(r["score"])) == (best, 1 - apart[best] / (size * len(own)))


def test_language_edges_and_accuracy(spark, tmp_path):
    docs = documents(spark, ROWS)
    out = language.op10_language(spark, write(docs, tmp_path)).collect()
    assert len(out) == len(ROWS)
    by_id = {r["doc_id"]: r for r in out}
    for i in (4, 5, 6, 11):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert not by_id[None]["held_out"]
    assert by_id[7]["held_out"] == (zlib.crc32(b"7") % 5 == 0)
    kept = language.keep_identified(spark, docs, None)
    assert kept.columns == docs.columns
    assert {4, 5, 6, 11}.isdisjoint(r["doc_id"] for r in kept.collect())
    empty = docs.filter("false")
    assert language.identify(empty, language.profiles(empty.select("lang", "text"))).count() == 0
    none = language.identify(docs, language.profiles(empty.select("lang", "text")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    checked = language.op10_language(spark, "/root/testdata/sf0.01").filter("held_out").join(real, "doc_id")
    assert checked.filter("lang = lang_pred").count() >= 0.99 * checked.count() > 0


# ---- exact ------------------------------------------------------------------------------------


@given(st.binary(max_size=5000), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_chunks_join_to_the_text_and_follow_content(data, front):
    ends = exact.boundaries(data, 16, 32, 128)
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(s <= 128 for s in sizes) and all(s >= 16 for s in sizes[:-1])


def test_shifted_text_keeps_most_chunks():
    rnd = random.Random(3)
    data = bytes(rnd.randrange(97, 123) for _ in range(200_000))

    def chunks(x):
        ends = exact.boundaries(x)
        return {x[a:b] for a, b in zip([0, *ends], ends)}

    assert len(chunks(data) & chunks(b"new front " + data)) > 0.8 * len(chunks(data))


def plain_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        key = (t or "").encode().lower()
        groups.setdefault(key, []).append(-1 if i is None else i)
    return sorted(
        (-1 if i is None else i, max(groups[k]), len(groups[k]), (-1 if i is None else i) == max(groups[k]), sha(k))
        for i, t, *_ in rows for k in [(t or "").encode().lower()]
    )


def test_exact_equals_plain(spark, monkeypatch):
    docs = documents(spark, ROWS)

    def got():
        return sorted(
            (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], *r[2:]) for r in exact.duplicates(docs).collect()
        )

    assert got() == plain_exact(ROWS)
    # Every identifier unverified: documents are compared by their whole texts.
    monkeypatch.setattr(exact, "unverified", lambda chunks: chunks.selectExpr("explode(recipe) AS chunk").distinct())
    assert got() == plain_exact(ROWS)
    assert exact.duplicates(docs.filter("false")).count() == 0


def test_clashing_identifiers_are_found(spark):
    rows = spark.createDataFrame([([1, 2], [b"a", b"b"]), ([1], [b"a"]), ([2], [b"c"])], "recipe array<long>, chunks array<binary>")
    assert [r[0] for r in exact.unverified(rows).collect()] == [2]


# ---- BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import tiktoken

    own = bpe.encoder(bpe.default_path())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


PARTS = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "'ll", "123", "!!", "\x00", "aaaa", "क्ष", "́"])


@given(st.one_of(st.text(max_size=80), st.lists(PARTS, max_size=40).map("".join)))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_tiktoken(encoders, text):
    own, reference = encoders
    ids = own.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode() and own.encode_named(text) == ",".join(map(str, ids))


def test_bpe_long_pieces_in_linear_time(encoders):
    own, reference = encoders
    rnd = random.Random(1)
    for text in ("a" * 20000, "ab" * 10000, "=" * 20000, "".join(rnd.choice("etaoin") for _ in range(30000))):
        assert own.encode(text) == reference.encode_ordinary(text)


def test_pairs_by_edges_equal_pairs_by_merging(encoders):
    own, _ = encoders
    rnd, ids = random.Random(5), sorted(own.tokens)
    assert own._in_order
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        left, right = own.tokens[a], own.tokens[b]
        assert own._pair_fits((a, b)) == (own._merge(left + right) == [left, right])


def test_bpe_frames(spark, encoders):
    _, reference = encoders
    docs = documents(spark, ROWS)
    expected = sorted(
        (-1 if i is None else i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
        for i, t, _ in ROWS for ids in [reference.encode_ordinary(t or "")]
    )
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe.round_trip(docs).collect())
    assert got == expected
    tokens = bpe.encode(docs)
    assert sorted(len(r["ids"]) for r in tokens.collect()) == sorted(e[1] for e in expected)
    assert sorted(sha(bytes(r["data"])) for r in bpe.decode(tokens).collect()) == sorted(e[3] for e in expected)
    assert bpe.round_trip(docs.filter("false")).count() == 0


# ---- packing ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_path())


WORDY = st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "!?", ".%%%", "The", "cat", ",", ". ", " ", "\n", "é", "İ", "Σ", "'s", "12", "́", "x" * 40, "日本", "\x1c", "…", "Ǆ"])


@given(st.one_of(st.text(max_size=60), st.lists(WORDY, max_size=30).map("".join)))
@settings(max_examples=300, deadline=None)
def test_words_equal_tokenizer(tokenizer, text):
    got = np.frombuffer(next(packing.word_encoder(packing.default_path()).encode_all([text])), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x <|startoftext|> y", "a<|endoftext|>b, <|endoftext|>.", "don't!'s", "Große, ÉTÉ. ǅ İx"])
def test_special_strings_are_special_tokens(tokenizer, text):
    got = np.frombuffer(next(packing.word_encoder(packing.default_path()).encode_all([text])), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_loses_nothing(spark, tokenizer):
    docs = documents(spark, ROWS)
    pieces = packing.pack(docs, window=64, with_ids=True).collect()
    wanted = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in ROWS)
    by_sequence = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    stream = []
    for s in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            stream.append(p)
        assert at == 64 or s == len(by_sequence) - 1
    found, current = [], []
    for p in stream:
        assert p["start"] == len(current)
        current += np.frombuffer(p["ids"], "<u4").tolist()
        if len(current) == p["doc_tokens"]:
            found.append(current)
            current = []
    assert sorted(found) == wanted and not current
    assert packing.pack(docs.filter("false")).count() == 0


def test_task_offsets_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "_GROUP", 2)
    tokens = spark.createDataFrame([(p, n) for p, n in ((0, 3), (0, 4), (1, 5), (3, 1), (4, 2), (5, 9))], "part int, n long")
    got = {r["part"]: r["base"] for r in packing.task_offsets(tokens).collect()}
    assert got == {0: 0, 1: 7, 3: 12, 4: 13, 5: 15}
