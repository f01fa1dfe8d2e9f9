"""The bucketed store and the stored keyword index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_pipeline import LONG, at, full_visits
from trailmark import schemas, session
from trailmark.operators import entities, lexical, postings
from trailmark.operators.postings import PostingsIndex
from trailmark.plans import ingest
from trailmark.sources.tables import Snapshots


def files(root):
    """Data file to its time of writing."""
    return {
        os.path.join(folder, name): os.path.getmtime(os.path.join(folder, name))
        for folder, _, names in os.walk(root) for name in names if name.endswith(".parquet")
    }


def bucket_of(path):
    return next(part for part in path.split(os.sep) if part.startswith("b="))


def held_files(store):
    return {path for df in store.load().values() for path in df.inputFiles()}


def visits(spark, pages, minute):
    rows = [(minute * 100 + i, u, "About " + u[-5:], t, at(minute)) for i, (u, t) in enumerate(pages.items())]
    return full_visits(spark, rows)


def page_text(word):
    return LONG.replace("clay", word)


def hits(index, spark, query):
    queries = spark.createDataFrame([(1, query)], "query_id long, query string")
    return {(r.chunk_id, r.score) for r in lexical.bm25(index, lexical.query_phrases(queries), 1000).collect()}


def fresh_index(chunks):
    return lexical.index_chunks(chunks)


def test_a_batch_of_one_page_leaves_other_buckets_alone(spark, tmp_path):
    settings = ingest.Settings(gate=False)
    store = Snapshots(spark, str(tmp_path / "t"), buckets=8)
    pages = {f"https://site{i}.org/docs/clay-{i:02}": page_text(f"clay{i}") for i in range(30)}
    ingest.ingest_into(store, visits(spark, pages, 1), settings)
    before, held = files(tmp_path / "t"), held_files(store)
    assert store.load()["pages"].count() == 30 and len({bucket_of(f) for f in held if "/pages/" in f}) > 5

    mark = session.written_mark()
    one = "https://site7.org/docs/clay-07"
    ingest.ingest_into(store, visits(spark, {one: page_text("tin")}, 2), settings, "stream", 0)
    assert session.written_mark() == mark and store.applied("stream", 0)  # nothing is left of the job
    after = files(tmp_path / "t")
    assert {f: after[f] for f in before} == before  # no file was touched
    new = held_files(store) - held
    tables = {f.split("/t/")[1].split("/")[0] for f in new}
    assert tables == {"pages", "chunks", "vectors", "page_entities"}
    assert len({bucket_of(f) for f in new}) == 1
    # What the store holds is what one table would hold.
    stored = store.load()
    assert stored["pages"].count() == 30 and stored["pages"].filter("visit_count = 2").first().url == one
    assert stored["chunks"].filter(F.col("text").contains("clay7 ")).count() == 0
    assert stored["chunks"].filter(F.col("page_url") == one).count() == stored["vectors"].filter(F.col("page_url") == one).count() > 0
    # An unchanged visit moves its page's bucket alone, a skipped one the counters'.
    held = held_files(store)
    ingest.ingest_into(store, visits(spark, {one: page_text("tin"), "https://x.org/short": "few words"}, 3), settings)
    assert {f.split("/t/")[1].split("/")[0] for f in held_files(store) - held} == {"pages", "skip_stats"}

    store.expire(1)
    left = files(tmp_path / "t")
    wanted = {f.removeprefix("file://").removeprefix("file:") for f in held_files(store)}
    assert {f for f in left if not any(part in f for part in ("/postings/", "/removed/", "/edges/"))} == wanted
    assert store.load()["pages"].count() == 30


def test_index_follows_the_chunks(spark, tmp_path):
    settings = ingest.Settings(gate=False)
    store = Snapshots(spark, str(tmp_path / "t"), buckets=4)
    assert store.index().n_chunks == 0 and hits(store.index(), spark, "kilns") == set()
    rnd = random.Random(4)
    urls = [f"https://site{i}.org/docs/pot-{i:02}" for i in range(12)]
    for minute in range(1, 5):
        batch = {u: page_text(rnd.choice(["tin", "lead", "zinc"])) for u in rnd.sample(urls, 5)}
        ingest.ingest_into(store, visits(spark, batch, minute), settings)
    assert len(store.record(store.committed()[-1])["postings"]) > 1 and store.index().removed is not None

    def check():
        index, chunks = store.index(), store.load()["chunks"]
        whole = fresh_index(chunks)
        assert (index.n_chunks, index.total_length) == tuple(whole.agg(F.count("*"), F.sum("length")).first())
        for query in ("tin pots", "old-harbour zinc", "kilns", "nothinglikeit"):
            assert hits(index, spark, query) == hits(whole, spark, query)
        return index

    check()
    tables, _ = ingest.delete_urls(store.load(), spark.createDataFrame([(u,) for u in urls[:6]], "url string"))
    ingest.commit_removal(store, tables)
    check()
    store.compact_index()
    assert check().removed is None
    store.expire(1)
    check()
    with pytest.raises(Exception):
        Snapshots(spark, str(tmp_path / "t")).record(1)


def test_edges_follow_the_pages(spark, tmp_path):
    settings = ingest.Settings(gate=False)
    store = Snapshots(spark, str(tmp_path / "t"), buckets=4)
    assert store.edges().count() == 0
    places = ["Red Harbour", "Blue Castle", "Green Valley", "Stone Bridge"]
    rnd = random.Random(6)
    urls = [f"https://site{i}.org/docs/pot-{i:02}" for i in range(8)]

    def check():
        kept = sorted(map(tuple, store.edges().collect()))
        assert kept == sorted(map(tuple, entities.cooccurrence(store.load()["page_entities"]).collect()))
        return kept

    for minute in range(1, 4):
        batch = {u: f"{LONG} We went to {rnd.choice(places)} and then on to {rnd.choice(places)}." for u in rnd.sample(urls, 5)}
        ingest.ingest_into(store, visits(spark, batch, minute), settings)
        assert check()
    segments = store.record(store.committed()[-1])["edges"]
    assert len(segments) == 3
    # An unchanged visit leaves the edges alone.
    ingest.ingest_into(store, visits(spark, batch, 4), settings)
    assert store.record(store.committed()[-1])["edges"] == segments
    tables, _ = ingest.delete_urls(store.load(), spark.createDataFrame([(u,) for u in urls[:6]], "url string"))
    ingest.commit_removal(store, tables)
    before = check()
    store.compact_edges()
    store.expire(1)
    assert check() == before and "Exchange" not in store.edges()._jdf.queryExecution().toString()
    # Entities that come without their delta: the edges are made again, until they are compacted.
    store.commit({"page_entities": store.load()["page_entities"].filter("key <> 'old harbour'")})
    assert store.record(store.committed()[-1])["edges"] is None and check() != before
    store.compact_edges()
    assert len(store.record(store.committed()[-1])["edges"]) == 1 and check()


def test_edges_are_written_slice_by_slice(spark, tmp_path, monkeypatch):
    """Segments of one, four and eight slices add up, and become one of two slices."""
    def page_entities(*pages):
        rows = [(f"https://a.org/{p}", f"n{i:02}", "N", "x") for p, names in pages for i in names]
        return spark.createDataFrame(rows, schemas.TABLES["page_entities"])

    def folders(version):
        return sorted(n for n in store._names(f"edges/v={version}") if "=" in n)

    store, none = Snapshots(spark, str(tmp_path / "s"), buckets=2), page_entities()
    first, second, third = page_entities(("1", range(20)), ("2", range(5, 30))), page_entities(("3", range(12))), page_entities(("2", range(3)))
    for slices, old, new, held in ((4, none, first, first), (1, none, second, first.unionByName(second)), (
        8, first.filter("page_url LIKE '%/2'"), third, first.filter("page_url LIKE '%/1'").unionByName(second).unionByName(third)
    )):
        store.commit({"page_entities": held, "edge_delta": entities.edge_delta(old, new, slices), "edge_slices": slices})
    want = sorted(map(tuple, entities.cooccurrence(held).collect()))
    assert [folders(v) for v in (1, 2, 3)] == [["n=4"], ["n=1"], ["n=8"]]
    assert sorted(map(tuple, store.edges().collect())) == want
    monkeypatch.setattr(entities, "PAIRS_PER_SLICE", 450)
    assert entities.edge_slices(held) == 1 and entities.edge_slices(first, first) == 4
    version = store.compact_edges()
    assert folders(version) == ["n=2"] and sorted(map(tuple, store.edges().collect())) == want
    # No edge is in two slices, and a slice holds those of its own alone.
    parts = [spark.read.schema(schemas.EDGE).parquet(f"{tmp_path}/s/edges/v={version}/n=2/i={i}") for i in range(2)]
    assert sum(p.count() for p in parts) == len(want) and all(entities.edge_slice(p, i, 2).count() == p.count() for i, p in enumerate(parts))


def test_positions_and_phrases(spark, tmp_path):
    rnd = random.Random(9)
    words = ["a1", "b1", "c1", "d1"]
    texts = {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for i in range(200)}
    texts[200] = None
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3)
    path = str(tmp_path / "p")
    postings.write(postings.of_chunks(chunks), path)
    rows = postings.read(spark, path, "bigint")
    index = PostingsIndex(rows, *postings.totals(rows))
    assert index.n_chunks == 201 and index.total_length == sum(len((t or "").split()) for t in texts.values())
    got = {(r.chunk_id, r.term): (r.length, list(r.positions)) for r in rows.filter(F.col("term").isNotNull()).collect()}
    expected = {}
    for i, t in texts.items():
        parts = (t or "").split()
        for k, w in enumerate(parts):
            expected.setdefault((i, w), (len(parts), []))[1].append(k)
    assert got == expected
    phrases = ["a1", "a1 b1", "a1 a1", "a1 a1 a1", "b1 a1 b1 a1", "d1 c1 zz", "zz"]
    found = {(r.phrase, r.chunk_id): r.tf for r in index.counts(spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    plain = {}
    for p in phrases:
        q = p.split()
        for i, t in texts.items():
            parts = (t or "").split()
            n = sum(parts[k : k + len(q)] == q for k in range(len(parts) - len(q) + 1))
            if n:
                plain[p, i] = n
    assert found == plain


def test_a_search_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    chunks = spark.createDataFrame([(str(i), f"common word{i}") for i in range(300)], "chunk_id string, text string")
    path = str(tmp_path / "p")
    postings.write(postings.of_chunks(chunks), path)
    rows = postings.read(spark, path)
    index = PostingsIndex(rows, *postings.totals(rows))
    found = index.of_terms(spark.createDataFrame([("word7",)], "term string"), fits=True)
    plan = found._jdf.queryExecution().toString()
    number = spark.range(1).select(postings.bucket_of(F.lit("word7"), index.buckets)).first()[0]
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {number})" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the postings are not shuffled
    assert found.count() == 1


def test_postings_travel_packed(spark, tmp_path):
    chunks = spark.range(400).selectExpr("id AS chunk_id", "concat('common words of ', id % 40, ' chunks') AS text").coalesce(1)
    rows = postings.of_chunks(chunks)
    # A row per term and block, not one per term and chunk: 4 words, 40 numbers and the lengths.
    assert rows.count() == 45
    path = str(tmp_path / "p")
    postings.write(rows, path)
    assert postings.read(spark, path, "bigint").count() == 400 * 6
    # Single postings, as compaction writes them, make the same index.
    postings.write(postings.read(spark, path, "bigint"), str(tmp_path / "q"))
    first, second = (postings.read(spark, str(tmp_path / n), "bigint").collect() for n in "pq")
    assert sorted(first, key=str) == sorted(second, key=str)


def test_phrases_are_followed_in_one_pass(spark, tmp_path):
    texts = ["new york new york", "york new", "in new york city", "new", "", "new york"] * 3
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    postings.write(postings.of_chunks(chunks), str(tmp_path / "p"))
    rows = postings.read(spark, str(tmp_path / "p"), "bigint")
    index = PostingsIndex(rows, *postings.totals(rows))
    wanted = spark.createDataFrame([(p,) for p in ("new york", "new york new", "york city", "york new york new")], "phrase string")
    followed = index.counts(wanted, True)
    # No list per phrase and chunk is gathered; the joins of larger batches find the same.
    assert "collect_list" not in followed._jdf.queryExecution().toString()
    got = {(r.chunk_id, r.length, r.phrase): r.tf for r in followed.collect()}
    assert got == {(r.chunk_id, r.length, r.phrase): r.tf for r in index.counts(wanted, False).collect()}
    assert got[0, 4, "new york"] == 2 and got[0, 4, "new york new"] == 1 and (0, 4, "york city") not in got and len(got) == 15
