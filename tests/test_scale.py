"""The paths for hot keys and large sides give the same rows as the plain ones."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import embedding, entities, fusion, graph, lexical, scale
from trailmark.session import materialize
from workload import graph_queries, search_queries, state_queries


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_lookup_join_paths_agree(spark, how):
    rng = random.Random(1)
    big = spark.createDataFrame([("hot" if i % 3 else f"k{rng.randint(0, 20)}", i) for i in range(600)], "k string, v int")
    small = spark.createDataFrame([("hot", 1.0), ("k1", 2.0), ("k2", 3.0)], "k string, w double")
    plain = rows(scale.lookup_join(big, small, "k", how))
    salted = rows(scale.lookup_join(big, small, "k", how, spread_by=F.col("v"), max_rows=1))
    assert plain == salted and len(plain) > 0


def test_large_sides_are_not_broadcast(spark):
    big = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    # A table that is small as files and large as rows, which Spark would broadcast by itself.
    small = materialize(spark.range(50).selectExpr("id AS k", "id * 2 AS w"))
    for spread_by in (None, F.col("v")):
        joined = scale.lookup_join(big, small, "k", spread_by=spread_by, max_rows=1)
        assert joined.count() == 1000
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_carry_forward_equals_one_window(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 5000), i, rng.choice(["a", "b", None])) for i in range(900)]
    frame = spark.createDataFrame(data, "k string, t int, seq int, v string")
    got = scale.carry_forward(frame, ["k"], F.floor(F.col("t") / 100), ["t", "seq"], F.col("v"), "p")
    whole = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    want = frame.withColumn("p", F.last("v", ignorenulls=True).over(whole))
    assert rows(got.select("k", "seq", "p")) == rows(want.select("k", "seq", "p"))


def plain_top(queries, vectors, k, apart=False):
    out = []
    for qid, q, qs in queries:
        scored = []
        for vid, v, vs in vectors:
            n = math.sqrt(sum(x * x for x in q)) * math.sqrt(sum(x * x for x in v))
            if not (apart and qs == vs):
                scored.append((-round(max(0.0, sum(a * b for a, b in zip(q, v)) / n if n else 0.0), 6), vid))
        out += [(qid, vid, -s + 0.0, r) for r, (s, vid) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cell, apart", [(64_000_000, None), (2_000, None), (1_000, "side")])
def test_nearest_equals_brute_force(spark, monkeypatch, cell, apart):
    rng = random.Random(3)
    # Many equal scores, zero vectors, and one side with a third of all rows.
    rows_ = [(i, [float(rng.randint(-2, 2)) for _ in range(4)], f"s{max(0, rng.randint(-2, 4))}") for i in range(300)]
    vectors = spark.createDataFrame(rows_, "chunk_id int, vector array<float>, side string")
    queries = vectors.filter("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), "vector", "side")
    got = embedding.nearest(queries, vectors, 5, cell_bytes=cell, apart=apart)
    assert sorted((tuple(r) for r in got.select("query_id", "chunk_id", "score", "rank").collect()), key=str) == plain_top(rows_[:40], rows_, 5, bool(apart))


def test_a_cell_takes_bounded_memory_and_skips_tiles():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))

    def units(n):
        m = centres[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 64))
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    queries, vectors = units(5_000), units(50_000)
    vectors = vectors[embedding._by_direction(vectors)]
    tracemalloc.start()
    scores, places = embedding.top_of_cell(queries, vectors, np.arange(50_000), 10, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000  # all scores at once would be 2 GB
    for q in range(0, 5_000, 500):
        exact = np.round(np.maximum(vectors @ queries[q], 0), 6)
        order = np.lexsort((np.arange(50_000), -exact))[:10]
        assert places[q].tolist() == order.tolist() and scores[q].tolist() == exact[order].tolist()


def test_zero_vectors_score_zero(spark):
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "chunk_id int, vector array<float>")
    queries = spark.createDataFrame([(7, [0.0, 1.0])], "query_id int, vector array<float>")
    assert [(r.chunk_id, r.score) for r in embedding.nearest(queries, vectors, 2).collect()] == [(1, 0.0), (2, 0.0)]


def test_one_hot_neighbour(spark):
    eye = spark.createDataFrame([(f"c{i + 1}", [float(i == j) for j in range(4)]) for i in range(3)], "chunk_id string, vector array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.1, 0.0, 0.0])], "query_id int, vector array<float>")
    assert embedding.nearest(query, eye, 1).first().chunk_id == "c1"


def test_bm25_paths_agree(spark):
    rng = random.Random(4)
    words = ["the", "the", "the", "cat", "dog", "don't", "new-york", "e-mail"]
    chunks = spark.createDataFrame(
        [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(200)], "chunk_id int, text string"
    )
    queries = spark.createDataFrame([(1, "the cat"), (2, 'new-york "dog" dog'), (3, "zzz"), (4, "e-mail don't")], "query_id int, query string")
    index, phrases = lexical.index_chunks(chunks), lexical.query_phrases(queries)
    broadcast = rows(lexical.bm25(index, phrases, 10))
    shuffled = rows(lexical.bm25(index, phrases, 10, max_broadcast=1))
    assert broadcast == shuffled and {r[0] for r in broadcast} == {1, 2, 4}


def test_bm25_against_a_plain_loop(spark):
    import math
    texts = {1: "red fish blue fish", 2: "red red bird", 3: "green tree", 4: "Réd café", 5: "blue bird sings a song"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "red fish")], "query_id int, query string")
    got = {r.chunk_id: r.score for r in lexical.bm25_search(chunks, queries, 10).collect()}
    tokens = {i: t.lower().replace("é", "e").split() for i, t in texts.items()}
    average = sum(map(len, tokens.values())) / len(tokens)

    def score(doc):
        total = 0.0
        for term in ("red", "fish"):
            df = sum(term in t for t in tokens.values())
            idf = max(math.log((5 - df + 0.5) / (df + 0.5)), 0) or 1e-6
            tf = doc.count(term)
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / average))
        return round(total, 6)

    assert got == {i: score(t) for i, t in tokens.items() if score(t) > 0}


def test_no_shuffle_between_postings_and_scores(spark):
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.lit("a b c").alias("text"))
    index = lexical.index_chunks(chunks)
    counted = lexical.postings(index).groupBy("chunk_id").agg(F.sum("tf"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = scale.top_rows(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_components_match_union_find(spark):
    rng = random.Random(5)
    n = 120
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(90)] + [(i, i + 1) for i in range(100, 119)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    name = "n{:03d}".format
    known = spark.createDataFrame([(name(i),) for i in range(n)], "key string")
    edges = spark.createDataFrame([(name(min(p)), name(max(p)), 1.0) for p in pairs], "a string, b string, weight double")
    got = {r.key: r.component for r in graph.components(known, edges).collect()}
    assert got == {name(i): name(find(i)) for i in range(n)}


def test_neighbours_on_a_chain(spark):
    known = spark.createDataFrame(
        [("a", "A", "language", 2), ("b", "B", "technology", 1), ("c", "C", "technology", 1)],
        "key string, name string, entity_type string, frequency long",
    )
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.5)], "a string, b string, weight double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    near = graph.neighbours(seeds, edges, known, 1).collect()
    assert [(r.node, r.distance) for r in near] == [("b", 1)]
    near = graph.neighbours(seeds, edges, known, 2).orderBy("rank").collect()
    assert [(r.node, r.distance, r.weight) for r in near] == [("b", 1, 2.0), ("c", 2, 1.5)]


def test_last_hop_bound_keeps_the_same_neighbours(spark):
    rng = random.Random(6)
    pairs = {tuple(sorted(rng.sample(range(40), 2))): float(rng.randint(1, 9)) for _ in range(150)}
    name = "n{:02d}".format
    known = spark.createDataFrame([(name(i), name(i), "x", 1) for i in range(40)], "key string, name string, entity_type string, frequency long")
    edges = spark.createDataFrame([(name(a), name(b), w) for (a, b), w in pairs.items()], "a string, b string, weight double")
    seeds = spark.createDataFrame([(name(i),) for i in range(5)], "seed string")
    few = rows(graph.neighbours(seeds, edges, known, 2, 3).select("seed", "node", "distance", "weight"))
    all_of_them = graph.neighbours(seeds, edges, known, 2, 1000)
    want = rows(scale.top_rows(all_of_them.drop("rank"), ["seed"], [F.desc("weight"), F.asc("distance"), F.asc("node")], 3)
                .select("seed", "node", "distance", "weight"))
    assert few == want


def _random_pages(spark, n_pages=120):
    """Pages with common and rare names, and two that hang together with no others."""
    rng = random.Random(9)
    pages = [(f"p{p}", f"n{i}") for p in range(n_pages) for i in {int(60 * rng.random() ** 3) for _ in range(rng.randint(1, 9))}]
    return spark.createDataFrame([*pages, ("q1", "lone"), ("q1", "other"), ("q2", "other"), ("q2", "third"), ("q3", "single")], "page_url string, key string")


def _entities_of(page_rows):
    return page_rows.groupBy("key").agg(F.count("*").alias("frequency")).select("key", F.upper("key").alias("name"), F.lit("x").alias("entity_type"), "frequency")


@pytest.mark.parametrize("k, names", [(1, 1), (3, 4), (5, 25), (500, 4), (3, 10_000)])
def test_neighbours_of_pages_equal_those_of_the_edges(spark, monkeypatch, k, names):
    monkeypatch.setattr(graph, "LEVEL_NAMES", names)
    pages = _random_pages(spark)
    known = _entities_of(pages)
    seeds = known.select(F.col("key").alias("seed"))
    want = rows(graph.neighbours(seeds, entities.cooccurrence(pages), known, 2, k))
    assert rows(graph.page_neighbours(seeds, pages, known, k)) == want


@pytest.mark.parametrize("query", [graph_queries.entity_context, graph_queries.neighbors_2hop, search_queries.graph_block])
def test_neighbours_make_no_edge_table(spark, monkeypatch, query):
    def unwanted(*_):
        raise AssertionError("all edges were made")

    monkeypatch.setattr(entities, "cooccurrence", unwanted)
    monkeypatch.setattr(search_queries.base, "_stored", {})
    assert query(spark, "/root/testdata/sf0.001").count() > 0


def test_entity_names_match_at_word_boundaries(spark):
    known = spark.createDataFrame(
        [("go lang", "Go Lang"), ("art", "Art"), ("c++ builder", "C++ Builder"), ("ai", "AI")], "key string, name string"
    )
    queries = spark.createDataFrame([(1, "start art with go  lang"), (2, "the C++ Builder and AI; go lang!")], "query_id int, query string")
    got = rows(entities.match_queries(queries, known).select("query_id", "key"))
    assert got == [(1, "art"), (2, "c++ builder"), (2, "go lang")]


def test_pairs_of_blocks_equal_pairs_of_pages(spark):
    from itertools import combinations

    sizes = {"p1": 1, "p2": 2, "p9": 9, "p40": 40, "p4": 4}
    names = {p: [f"e{i:02}" for i in range(n)] for p, n in sizes.items()}
    page_rows = spark.createDataFrame([(p, e, len(es)) for p, es in names.items() for e in es], "page_url string, key string, ts int")
    got = [tuple(r) for r in entities.page_pairs(page_rows, ("ts",), block=4).collect()]
    assert sorted(got) == sorted((p, len(es), a, b) for p, es in names.items() for a, b in combinations(es, 2))
    old = page_rows.filter("page_url <> 'p2'")
    delta = entities.edge_delta(old.filter("page_url = 'p9'"), page_rows.filter("page_url IN ('p9', 'p2') AND key <> 'e00'"))
    after = rows(entities.apply_delta(entities.cooccurrence(old), delta))
    assert after == rows(entities.cooccurrence(page_rows.filter("NOT (page_url IN ('p9', 'p2') AND key = 'e00')")))


def test_card_pages_are_picked(spark):
    from trailmark.operators import assembly

    pages = spark.createDataFrame([(f"https://a.org/{i}",) for i in range(20)], "url string")
    asked = spark.createDataFrame([("https://a.org/3/",), ("https://a.org/4",), ("https://a.org/none",)], "url string")
    assert sorted(r.url for r in assembly.pick_pages(pages, asked).collect()) == ["https://a.org/3", "https://a.org/4"]
    first = [assembly.pick_pages(pages, seed=s).first().url for s in ("a", "a", "b", "c", "d")]
    assert first[0] == first[1] and len(set(first)) > 1


def test_replaced_chunks_keep_their_length(spark, tmp_path):
    text = "stra\u00dfe \ufb01n " * 200
    spark.createDataFrame([(1, text, "fr", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT 1L AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(state_queries.chunk_replace(spark, str(tmp_path))) == [(1, "https://s.example.com/fr", len(text))]


def test_a_search_makes_no_pairs(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("a search read the edges")

    monkeypatch.setattr(entities, "page_pairs", unwanted)
    monkeypatch.setattr(search_queries.base, "_stored", {})
    assert search_queries.graph_leg(spark, "/root/testdata/sf0.001").count() > 0


def test_stars_have_the_components_of_pairs(spark):
    rows = [("p1", k) for k in "abcdefgh"] + [("p2", k) for k in "hij"] + [("p3", k) for k in "xyz"] + [("p4", "lone")]
    pages = spark.createDataFrame(rows, "page_url string, key string")
    known, stars = pages.select("key").distinct(), entities.page_stars(pages)
    assert sorted(map(tuple, stars.collect())) == sorted(
        [("a", k) for k in "bcdefgh"] + [("h", "i"), ("h", "j"), ("x", "y"), ("x", "z")]
    )
    want = graph.components(known, entities.cooccurrence(pages)).collect()
    assert sorted(graph.components(known, stars).collect()) == sorted(want)


def test_the_nodes_of_an_export_make_no_edges(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph_queries, "materialize", lambda rows: written.append(rows.columns) or materialize(rows))
    nodes = graph_queries.graph_nodes(spark, "/root/testdata/sf0.001")
    assert nodes.count() > 0 and written == [["page_url", "key", "name", "entity_type"]]


def test_pairs_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(entities, "PAIRS_PER_TASK", 50)
    pages = spark.createDataFrame([(f"p{p}", f"k{k:02d}") for p in range(60) for k in range(11)], "page_url string, key string")
    found = entities.page_pairs(pages).withColumn("task", F.spark_partition_id())
    assert found.count() == 60 * 55
    assert found.select("task").distinct().count() > 20


def test_hydrate_looks_for_the_hits_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    fused = spark.createDataFrame([(1, i, 1.0 / i, "bm25", i) for i in range(1, 6)], "query_id long, chunk_id long, score double, source string, fused_rank long")
    chunks = spark.range(9).selectExpr("id AS chunk_id", "concat('p', id) AS page_url", "'text' AS text")
    pages = chunks.selectExpr("page_url", "'title' AS page_title", "TIMESTAMP '2024-01-01 00:00:00' AS last_visited")
    hits = fusion.hydrate(fused.mapInPandas(count, fused.schema), chunks, pages, 3, F.lit("2024-01-01").cast("timestamp"))
    assert [(r.rank, r.chunk_id) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert seen.value == 5
