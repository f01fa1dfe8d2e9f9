"""Chunks, fusion, page state, dwell and the ingest job on small hand-made rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from trailmark import schemas
from trailmark.functions import text as T
from trailmark.operators import admission, assembly, chunking, embedding, fusion, state
from trailmark.operators.embedding import Embedder
from trailmark.plans import ingest, search
from trailmark.sources import tables as sources
from trailmark.streaming import dwell


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def keyword_embedder(*pairs, dim=2):
    def load():
        def embed(texts):
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                for word, vector in pairs:
                    if word in text.lower():
                        out[i] = vector
            return out
        return embed
    return Embedder(load, dim, "keywords")


# ---- chunking against a plain model ---------------------------------------------------------


def pieces(spark, cases):
    frame = spark.createDataFrame(cases, "id int, words array<long>, ends array<boolean>")
    segments = chunking.merge_small(F.col("words"), F.col("ends"))
    return {r.id: list(r.p) for r in frame.select("id", chunking.split_oversized(F.col("words"), segments, 384).alias("p")).collect()}


def test_merge_and_split_by_hand(spark):
    yes, no = True, False
    cases = [
        (0, [60, 60, 60], [yes, yes, yes]),  # every segment is large enough
        (1, [20, 20, 20, 60], [yes, yes, yes, yes]),  # three small ones are one
        (2, [60, 10], [yes, yes]),  # a small rest joins the one before
        (3, [10], [yes]),  # or stays alone
        (4, [200, 200, 176], [no, no, yes]),  # 576 words: 1.5 times the limit stays whole
        (5, [200, 200, 177], [no, no, yes]),  # one more is cut before the limit is passed
        (6, [700, 10, 10], [no, no, yes]),  # a sentence longer than the limit stands alone
        (7, [10, 700], [yes, yes]),
    ]
    assert pieces(spark, cases) == {
        0: [1, 2, 3], 1: [3, 4], 2: [2], 3: [1], 4: [3], 5: [1, 3], 6: [1, 3], 7: [1, 2],
    }


def test_merge_and_split_properties(spark):
    rng = random.Random(7)
    cases = []
    for n in range(60):
        words = [rng.choice([3, 10, 40, 90, 300, 700]) for _ in range(rng.randint(1, 40))]
        cases.append((n, words, [rng.random() < 0.4 for _ in words[1:]] + [True]))
    for n, cuts in pieces(spark, cases).items():
        _, words, ends = cases[n]
        assert cuts == sorted(set(cuts)) and cuts[-1] == len(words)
        for i, j in zip([0, *cuts], cuts):
            total, topics = sum(words[i:j]), ends[j - 1]
            assert total <= 1.5 * 384 or j - i == 1
            # A cut inside a topic is there because the piece could take no more words.
            assert topics or total + words[j] > 384


def test_fixed_ends(spark):
    frame = spark.createDataFrame([([200, 200, 10, 400, 5],)], "words array<long>")
    got = frame.select(chunking.fixed_ends(F.col("words"), 384).alias("e")).first()["e"]
    assert got == [False, True, False, True, True]


def test_sentences(spark):
    text = "First sentence here. Second one follows! tiny.\nA line of its own\n\n  Indented line stays."
    frame = spark.createDataFrame([(text,)], "content string")
    got = frame.select(chunking.split_sentences(F.col("content")).alias("s")).first()["s"]
    assert got == ["First sentence here.", "Second one follows! tiny.", "A line of its own", "Indented line stays."]


def page(topics):
    return " ".join(f"Sentence number {i} talks about {t} with some more words to fill the line." for i, t in enumerate(topics))


def test_topic_change_starts_a_chunk(spark):
    embedder = keyword_embedder(("apples", (1, 0)), ("rockets", (0, 1)))
    text = page(["apples"] * 20 + ["rockets"] * 20)
    frame = spark.createDataFrame([("https://a.b/x", "T", text)], "url string, title string, content string")
    got = chunking.chunk_pages(frame, embedder).orderBy("chunk_index").collect()
    assert len(got) == 2 and "rockets" not in got[0].text[:-400] and "apples" not in got[1].text
    assert got[0].context_prefix == "[T] (https://a.b/x)"


def test_failing_embedder_falls_back_to_fixed_cuts(spark):
    def load():
        def embed(texts):
            raise RuntimeError("no model")
        return embed
    text = page(["apples"] * 80)
    frame = spark.createDataFrame([("https://a.b/x", "T", text)], "url string, title string, content string")
    got = chunking.chunk_pages(frame, Embedder(load, 2, "none")).collect()
    assert len(got) == 3 and sum(r.token_count for r in got) == len(text.split())


def test_text_of_short_sentences_is_cut_by_words(spark):
    shouted = " ".join(f"WORD{i}!!" for i in range(1000))
    pages = spark.createDataFrame([("s", "", shouted), ("e", "", " \n"), ("o", "", "Ok. Go.")], "url string, title string, content string")
    found = chunking.chunk_pages(pages, embedding.hash_embedder(16), splitter=chunking.sentences_or_words)
    got = {}
    for r in found.orderBy("page_url", "chunk_index").collect():
        got.setdefault(r["page_url"], []).append(r["text"])
    assert " ".join(got["s"]) == shouted and len(got["s"]) > 1
    assert got["o"] == ["Ok. Go."] and "e" not in got


def test_short_text_is_one_chunk(spark):
    frame = spark.createDataFrame([("u", "", "Only one short sentence."), ("v", "", "tiny")], "url string, title string, content string")
    got = chunking.chunk_pages(frame, embedding.hash_embedder()).collect()
    assert [(r.page_url, r.chunk_index, r.text, r.context_prefix) for r in got] == [("u", 0, "Only one short sentence.", "")]


# ---- fusion ---------------------------------------------------------------------------------


def legs(spark, **lists):
    out = None
    for name, ids in lists.items():
        frame = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank long")
        part = fusion.leg(frame, name)
        out = part if out is None else out.unionByName(part)
    return out


def test_fusion_ties_and_repeats(spark):
    fused = fusion.reciprocal_rank_fusion(
        legs(spark, bm25=["a", "b"], dense=["b", "a", "c"], knowledge_graph=["d", "c", "d"]), 10
    ).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in fused] == ["a", "b", "c", "d"]
    score = {r.chunk_id: r.score for r in fused}
    assert score["d"] == round(0.8 / 61 + 0.8 / 63, 6)
    assert score["c"] == round(1 / 63 + 0.8 / 62, 6)
    assert fused[0].source == "bm25+dense" and fused[2].source == "dense+knowledge_graph"


def test_recency_and_date_range(spark):
    chunks = spark.createDataFrame([("a", "u1", "x"), ("b", "u2", "y")], "chunk_id string, page_url string, text string")
    pages = spark.createDataFrame([("u1", "t1", at(0)), ("u2", "t2", at(60 * 24 * 10))], "page_url string, page_title string, last_visited timestamp")
    fused = fusion.reciprocal_rank_fusion(legs(spark, bm25=["a", "b"]), 10)
    now = F.lit(at(60 * 24 * 11))
    got = fusion.hydrate(fused, chunks, pages, 5, now).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a"]
    still = fusion.hydrate(fused, chunks, pages, 5, now, decay=1.0).orderBy("rank").collect()
    assert [r.chunk_id for r in still] == ["a", "b"]
    late = fusion.hydrate(fused, chunks, pages, 5, now, date_from=F.lit(at(60)))
    assert [r.chunk_id for r in late.collect()] == ["b"]


def test_rerank_keeps_order_without_scores(spark):
    hits = spark.createDataFrame(
        [(1, 1, "blue sky", 0.5, "u1/"), (1, 2, "red fish", 0.4, "u1?x=1"), (1, 3, "red", 0.3, "u2")],
        "query_id int, rank long, text string, score double, page_url string",
    )
    queries = spark.createDataFrame([(1, "red fish")], "query_id int, query string")
    ranked = fusion.rerank(hits, queries, 2).orderBy("rank").collect()
    assert [(r.text, r.score, r.retrieval_score) for r in ranked] == [("red fish", 1.0, 0.4), ("red", 0.5, 0.3)]
    same = fusion.rerank(hits, queries, 3, scorer=lambda q, t: F.lit(None).cast("double")).orderBy("rank").collect()
    assert [r.text for r in same] == ["blue sky", "red fish", "red"]
    best = fusion.one_per_page(hits, 5).orderBy("rank").collect()
    assert [(r.rank, r.page_url) for r in best] == [(1, "u1/"), (2, "u2")]
    assert fusion.rerank(hits, queries, 5, threshold=0.9).count() == 1
    assert fusion.rerank(hits.limit(0), queries, 5).count() == 0


def test_query_instruction_goes_to_queries_only():
    assert T.query_instruction("BAAI/bge-base-en-v1.5").startswith("Represent this sentence")
    assert T.query_instruction("all-MiniLM") == "" and T.query_instruction("") == ""


def test_related_page_skips_own_site(spark):
    chunk_pages = spark.createDataFrame(
        [("1", "https://a.com/1"), ("2", "https://a.com/2"), ("3", "https://b.com/1"), ("4", "https://c.com/1")],
        "chunk_id string, page_url string",
    )
    vectors = spark.createDataFrame(
        [("1", [1.0, 0.0]), ("2", [1.0, 0.0]), ("3", [0.9, 0.1]), ("4", [0.0, 1.0])], "chunk_id string, vector array<float>"
    )
    anchors = spark.createDataFrame([("https://a.com/1",), ("https://c.com/1",)], "url string")
    got = search.related_pages(anchors, chunk_pages, vectors).collect()
    assert [(r.url, r.page_url) for r in got] == [("https://a.com/1", "https://b.com/1")]
    fallback = spark.createDataFrame([("https://new.org/", "apples", "")], "url string, title string, content string")
    embedder = keyword_embedder(("apples", (0, 1)))
    got = search.related_pages(fallback, chunk_pages, vectors, fallback=fallback, embedder=embedder).collect()
    assert [(r.url, r.page_url) for r in got] == [("https://new.org/", "https://c.com/1")]


def test_gate_is_relative_and_fails_open(spark):
    embedder = keyword_embedder(("sign in", (1, 0)), ("programming", (0, 1)))
    proto = spark.createDataFrame([("login", "sign in page"), ("docs", "programming text")], "label string, s string")
    vectors = proto.select("label", embedder.vector(F.col("s")).alias("vector"))
    texts = spark.createDataFrame([("please sign in",), ("programming guide",), ("",)], "t string")
    judged = embedding.prototype_gate(
        texts.withColumn("vector", embedder.vector(F.col("t"))), vectors.filter("label = 'login'"), vectors.filter("label = 'docs'")
    ).collect()
    assert [r.is_junk for r in judged] == [True, False, False]


# ---- page state -----------------------------------------------------------------------------


def visits(spark, rows):
    frame = spark.createDataFrame(rows, "visit_id long, url string, ts timestamp, content_hash string, title string")
    return frame.select(
        "*", F.lit("d").alias("domain"), F.lit("other").alias("content_type"), F.lit(0.5).alias("quality_score"),
        F.lit(10).cast("long").alias("word_count"), F.lit("").alias("meta_description"), F.lit("").alias("meta_author"),
    )


def test_upsert_replays_visits(spark):
    none = spark.createDataFrame([], schemas.PAGE)
    batch = visits(spark, [(1, "u", at(0), "abc", "one"), (2, "u", at(90), "abc", "two"), (3, "u", at(200), "xyz", "three"), (4, "u", at(300), "xyz", "four")])
    changes = state.classify_visits(batch, none)
    assert [r.change for r in changes.orderBy("visit_id").collect()] == ["new", "unchanged", "changed", "unchanged"]
    row = state.upsert_pages(changes, none).first()
    assert (row.visit_count, row.content_hash, row.title) == (4, "xyz", "three")
    assert row.last_indexed == row.last_visited - dt.timedelta(minutes=100)


def test_batches_equal_one_run(spark):
    rng = random.Random(8)
    rows = [(i, f"u{0 if i % 3 else i % 7}", at(rng.randint(0, 3000)), rng.choice("ab"), str(i)) for i in range(200)]
    none = spark.createDataFrame([], schemas.PAGE)
    whole = state.upsert_pages(state.classify_visits(visits(spark, rows), none), none)
    pages = none
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for part in (ordered[:70], ordered[70:71], ordered[71:]):
        pages = state.upsert_pages(state.classify_visits(visits(spark, part), pages), pages)
    assert sorted(whole.collect(), key=str) == sorted(pages.collect(), key=str)


def test_pages_without_hash_are_indexed_again(spark):
    none = spark.createDataFrame([], schemas.PAGE)
    pages = state.upsert_pages(state.classify_visits(visits(spark, [(1, "u", at(0), "abc", "t")]), none), none)
    bare = pages.withColumn("content_hash", F.lit(""))
    again = visits(spark, [(2, "u", at(5), "abc", "t")])
    assert state.classify_visits(again, bare).first().change == "changed"
    assert state.classify_visits(again, pages).first().change == "unchanged"


def test_delete_tries_the_slash_variant(spark):
    pages = spark.createDataFrame([("a/",), ("b",), ("c",)], "url string")
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "url string")
    assert sorted(r.url for r in state.resolve_urls(asked, pages).collect()) == ["a/", "b"]


def test_retention_can_be_switched_off(spark):
    pages = spark.createDataFrame([("a", at(0))], "url string, last_visited timestamp")
    late = F.lit(at(60 * 24 * 400))
    assert state.expired_pages(pages, late, 0).count() == 0
    assert state.expired_pages(pages, late, 120).count() == 1


# ---- ingest ---------------------------------------------------------------------------------


def full_visits(spark, rows):
    return spark.createDataFrame(
        [(i, u, t, c, None, "", "", 40.0, ts, 0, 5.0) for i, u, t, c, ts in rows], schemas.VISIT
    )


LONG = " ".join(f"Paragraph {i} of Northwind Museum explains clay pots and kilns in Old Harbour again." for i in range(60))


def test_ingest_end_to_end(spark, tmp_path):
    settings = ingest.Settings(gate=False)
    store = sources.Snapshots(spark, str(tmp_path / "tables"))
    batch = full_visits(spark, [
        (1, "https://site.org/docs/clay-pots", "Clay pots explained", LONG, at(0)),
        (2, "https://bank.chase.com/x", "Bank", LONG, at(1)),
        (3, "https://site.org/x", "x", "too short", at(2)),
        (4, "https://site.org/docs/card-page", "Card page here", LONG[:2000] + " 4111 1111 1111 1111", at(3)),
        (5, "https://site.org/docs/clay-pots", "Other title", LONG, at(4)),
        (6, "", "no url", LONG, at(5)),
    ])
    outcomes, tables = ingest.ingest(batch, store.load(), settings)
    got = {r.visit_id: (r.status, r.reason) for r in outcomes.collect()}
    assert got == {
        1: ("indexed", "new"), 2: ("skipped", "url_blocked"), 3: ("skipped", "low_quality"),
        4: ("skipped", "pii:card"), 5: ("skipped", "unchanged"), 6: ("rejected", "invalid:url"),
    }
    assert store.commit(tables) == 1 and store.edges().count() > 0
    stored = store.load()
    row = stored["pages"].first()
    assert (row.url, row.visit_count, row.title) == ("https://site.org/docs/clay-pots", 2, "Clay pots explained")
    assert stored["chunks"].count() == stored["vectors"].count() > 0
    known, edges = ingest.derived_graph(stored)
    assert {"northwind museum", "old harbour"} <= {r.key for r in known.collect()} and edges.count() > 0
    assert sorted(ingest.rebuild_entities(stored["chunks"]).collect(), key=str) == sorted(stored["page_entities"].collect(), key=str)

    # The same page changes: its chunks and vectors are replaced, nothing is left behind.
    second = full_visits(spark, [(7, "https://site.org/docs/clay-pots", "New title", LONG.replace("clay", "tin")[: len(LONG) // 3], at(10))])
    outcomes, tables = ingest.ingest(second, stored, settings)
    assert [(r.status, r.reason) for r in outcomes.collect()] == [("indexed", "changed")]
    assert store.commit(tables) == 2
    after = store.load()
    assert after["pages"].first().title == "New title" and after["pages"].first().visit_count == 3
    ids = {r.chunk_id for r in after["chunks"].collect()}
    assert ids == {r.chunk_id for r in after["vectors"].collect()}
    assert store.committed() == [1, 2]

    left, counts = ingest.evict(after, F.lit(at(60 * 24 * 200)))
    assert counts.first().pages == 1 and all(left[t].count() == 0 for t in ("pages", "chunks", "vectors", "page_entities"))
    left, counts = ingest.delete_domain(after, "www.site.org")
    assert counts.first().pages == 1 and left["skip_stats"].count() == 3
    left, counts = ingest.delete_urls(after, spark.createDataFrame([("https://site.org/docs/clay-pots/",)], "url string"))
    assert counts.first().pages == 1
    store.expire(1)
    assert store.committed() == [2]


def test_visits_that_share_a_capture_come_out_the_same(spark):
    pages = {
        "a": ("https://site.org/docs/clay-pots", "Clay pots explained", LONG),
        "b": ("https://site.org/docs/clay-pots", "Clay pots again", LONG.replace("clay", "tin")),
        "c": ("https://bank.chase.com/x", "Bank", LONG), "d": ("", "no url", LONG),
    }
    seen = [(i, "abacd"[i % 5], at(i)) for i in range(15)]
    settings, none = ingest.Settings(gate=False), sources.empty_tables(spark)
    want, tables = ingest.ingest(full_visits(spark, [(i, *pages[k], ts) for i, k, ts in seen]), none, settings)
    captures = full_visits(spark, [(ord(k), *p, at(0)) for k, p in pages.items()]).withColumn(
        "capture_id", F.char("visit_id")).drop("visit_id", "ts")
    visits = spark.createDataFrame(seen, "visit_id long, capture_id string, ts timestamp")
    got, shared = ingest.ingest(visits, none, settings, captures)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    for name in ("pages", "chunks", "page_entities", "skip_stats"):
        left, right = (t[name].select(*none[name].columns) for t in (shared, tables))
        assert sorted(left.collect(), key=str) == sorted(right.collect(), key=str), name


def test_maintenance_between_batches_loses_nothing(spark, tmp_path):
    store = sources.Snapshots(spark, str(tmp_path / "tables"))
    empty = sources.empty_tables(spark)

    def with_pages(urls):
        rows = [tuple(u if f == "url" else at(0) if f.endswith(("visited", "indexed")) else None for f in empty["pages"].columns) for u in urls]
        return {**store.load(), "pages": spark.createDataFrame(rows, empty["pages"].schema)}

    def urls():
        return sorted(r.url for r in store.load()["pages"].collect())

    store.commit(with_pages(["a"]), "visits", 0)
    from trailmark.streaming.ingest import daily_maintenance

    daily_maintenance(store, F.lit(at(1)), 30)
    assert not store.applied("visits", 1) and store.applied("visits", 0) and not store.applied("other", 0)
    store.commit(with_pages(["a", "b"]), "visits", 1)
    store.commit(with_pages(["a", "b", "c"]), "other", 0)
    assert urls() == ["a", "b", "c"] and store.applied("visits", 1) and store.applied("other", 0)
    # Tables that a commit leaves out are not written again.
    version = store.commit({"skip_stats": empty["skip_stats"]})
    assert max(store.record(version)["tables"]["pages"].values()) < version and urls() == ["a", "b", "c"]
    store.expire(1)
    assert urls() == ["a", "b", "c"] and store.committed()[-1] == version


def test_gate_asks_the_model_about_survivors_only_and_fails_open(spark, tmp_path):
    log = str(tmp_path / "asked")

    def load():
        def embed(texts):
            with open(log, "a") as out:
                out.writelines(f"{t[:20]}\n" for t in texts)
            if any(t.startswith("Clay") for t in texts):
                raise RuntimeError("model lost")
            return np.ones((len(texts), 2))
        return embed

    rows = [(1, "https://site.org/docs/clay-pots", "Clay pots explained", "Clay " + LONG, at(0)),
            (2, "https://bank.chase.com/x", "Bank", LONG, at(1)), (3, "https://site.org/x", "x", "too short", at(2))]
    judged = ingest.judge(full_visits(spark, rows), ingest.Settings(embedder=Embedder(load, 2, "fails")))
    got = {r.visit_id: r.skip_reason for r in judged.collect()}
    assert got == {1: None, 2: "url_blocked", 3: "low_quality"}
    asked = [line for line in open(log).read().splitlines() if line.startswith(("Clay", "too")) or line == ""]
    assert set(asked) == {("Clay " + LONG)[:20]}


def test_funnel_counts_sum_to_the_input(spark):
    rows = [(i, f"https://site.org/docs/p{i}", "a b c", LONG if i % 2 else "few words", at(i)) for i in range(20)]
    outcomes, _ = ingest.ingest(full_visits(spark, rows), sources.empty_tables(spark))
    assert outcomes.count() == 20 and outcomes.select("visit_id").distinct().count() == 20


def test_export_writes_json(spark, tmp_path):
    pages = spark.createDataFrame([("u", at(0))], "url string, last_visited timestamp")
    marks = spark.createDataFrame([(1, "text", "u", "t", at(0))], schemas.HIGHLIGHT)
    sources.append_highlights(marks, str(tmp_path / "h"))
    sources.append_highlights(marks.withColumn("id", F.lit(2).cast("long")), str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    sources.export_json(pages, stored, pages.agg(F.count("*").alias("pages")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "highlights")).count() == 2
    assert admission.saveable_highlights(stored).count() == 0  # four characters are too few


# ---- dwell and conversations ----------------------------------------------------------------


def tab_events(spark):
    rows = [
        (1, at(0), 1, "activated", "https://a.org/1", "a"),
        (1, at(1), 2, "updated", "https://a.org/2", "b"),       # 60 s on the first page: reported
        (1, at(1.2), 3, "updated", "https://a.org/3", "c"),     # 12 s: not reported
        (1, at(1.9), 4, "alarm", None, None),                   # 42 s: reported once
        (1, at(3), 5, "updated", "https://a.org/4", "d"),
        (1, at(3.1), 6, "removed", None, None),                 # closed too early
        (2, at(0), 7, "updated", "https://b.org/1", "x"),
        (2, at(1), 8, "updated", "https://chase.com/", "bank"),  # not captured: the visit goes on
        (2, at(2), 9, "removed", None, None),
    ]
    return spark.createDataFrame(rows, "tab_id long, ts timestamp, seq long, kind string, url string, title string")


def test_dwell_state_machine(spark, tmp_path):
    tab_events(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tab_events(spark).schema).parquet(str(tmp_path / "in"))
    query = (
        dwell.stream_dwell(stream).writeStream.format("memory").queryName("dwell_out")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.tab_id, r.url, r.dwell_seconds) for r in spark.table("dwell_out").collect())
    assert got == [(1, "https://a.org/1", 60.0), (1, "https://a.org/3", 42.0), (2, "https://b.org/1", 120.0)]


def test_chat_queries_look_back_to_the_last_user(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "first"), (1, 2, "assistant", "<context>x"), (1, 3, "user", "second"), (2, 5000, "user", "z" * 500)],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r.conv_id, r.turn): r.query for r in assembly.retrieval_queries(turns).collect()}
    assert got == {(1, 1): "first", (1, 3): "first second", (2, 5000): "z" * 500}
    history = assembly.chat_histories(turns).filter("conv_id = 1").first().messages
    assert [(m.role, m.content) for m in history] == [("user", "first"), ("assistant", "[context>x"), ("user", "second")]


def test_long_texts_reach_a_model_in_blocks(spark):
    text = "Alpha beta gamma. " * 20 + "\n" + "Delta epsilon zeta. " * 20 + "x" * 250
    blocks = chunking.text_blocks(text, 100)
    assert all(0 < len(b) <= 100 for b in blocks) and "".join(blocks) == text
    assert all(b.endswith((". ", "\n")) or "x" in b for b in blocks)
    assert chunking.text_blocks(text) == [text] and chunking.text_blocks("") == []
    splitter = chunking.model_splitter(lambda: lambda block: block.split(". "))
    broken = chunking.model_splitter(lambda: lambda block: 1 / 0)
    frame = spark.createDataFrame([("One two three four. Five six seven eight. Nine",)], "t string")
    assert frame.select(splitter(F.col("t")).alias("s")).first().s == ["One two three four", "Five six seven eight"]
    assert frame.select(broken(F.col("t")).alias("s")).first().s == ["One two three four.", "Five six seven eight."]


def test_names_slugs_and_markup_of_any_length(spark):
    import time

    from trailmark.operators import extract
    from trailmark.operators.entities import capitalised_runs

    frame = spark.createDataFrame([("Name " * 100_000, "https://a.org/" + "-".join(["part"] * 1600))], "t string, url string")
    assert frame.select(F.size(capitalised_runs(F.col("t"))).alias("n")).first().n == 1
    from trailmark.functions import rules
    assert frame.select(F.col("url").rlike("(?U)" + rules.SLUG_PATH).alias("x")).first().x
    start = time.time()
    for page in ('<a title="x ' * 80_000, "<!-- " * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<a 'x' \"y\" " * 80_000):
        extract._extract(page)
    assert time.time() - start < 60


def test_streams_count_activity(spark, tmp_path):
    from trailmark.streaming import activity

    rows = [(1, at(0)), (1, at(10)), (1, at(100)), (2, at(5))]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")

    def run(frame, name):
        out = frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
        out.option("checkpointLocation", f"{tmp_path}/{name}").start().awaitTermination()
        return sorted((r.user_id, r.n) for r in spark.table(name).collect())

    assert run(activity.activity_windows(stream, "1 hour"), "windows") == [(1, 1), (1, 2), (2, 1)]
    assert run(activity.sessions(stream), "sessions") == [(1, 1), (1, 2), (2, 1)]
