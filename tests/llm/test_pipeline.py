"""The pipeline's stages, one after the other, against plain models."""

import corpus_pipeline
from tests.llm.edge import documents, write
from tests.llm.test_native_operators import plain_base
from tests.llm.test_pair_operators import copies, plain_near
from trailmark.llm import exact, language, near, packing


def test_pipeline(spark, tmp_path):
    rows = copies(21, 25, 6)
    rows += [(500 + i, f"{t} write to x{i}@mail.example.org or call +1 (234) 567-89{i:02}", "en") for i, (_, t, _) in enumerate(copies(5, 10, 1))]
    rows += [(600, "123 456", "en"), (601, None, "en"), (602, "", None), (603, rows[0][1].upper(), "en")]
    folder = write(documents(spark, rows), tmp_path)
    docs, texts = spark.read.parquet(f"{folder}/documents.parquet"), dict((i, t) for i, t, _ in rows)
    columns, kept = docs.columns, set(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert docs.columns == columns
            ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert kept - ids == {600, 601, 602}
        if name == "exact_dedup":
            last = {}
            for i in sorted(kept):
                last[texts[i].lower()] = i
            assert ids == set(last.values())
        if name == "near_dedup":
            plain = plain_near([(i, texts[i], None) for i in kept])
            assert ids == {i for i in kept if plain[i][1] == i}
        if name == "pii":
            assert ids == kept
            for r in docs.select("doc_id", "text").collect():
                assert not plain_base(r["text"])
                assert plain_base(texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]]
                texts[r["doc_id"]] = r["text"]
        if name != "packing":
            kept = ids
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    encode = packing.word_encoder(packing.default_path()).encode_all
    lengths = {i: len(next(encode([texts[i]]))) // 4 + 1 for i in kept}
    pieces = docs.collect()
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == lengths
    ran = corpus_pipeline.run(spark, folder)
    assert ran.columns == docs.columns and ran.count() == len(pieces)


def test_known_languages_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language.keep_identified(spark, docs, None).count() == docs.count()


def test_stages_drop_rows_and_not_ids(spark):
    """Ids that repeat or are null: a text never goes because of the id of another row."""
    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string").repartition(3)
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        return sorted(((r[0], r[1]) for r in out.collect()), key=str)

    rows = [(7, "x"), (7, "y"), (9, "X"), (None, "x"), (None, "z"), (7, "y"), (None, None), (3, "")]
    assert left(exact.keep_last_copy, rows) == sorted([(7, "y"), (9, "X"), (None, "z"), (3, "")], key=str)
    assert left(exact.keep_last_copy, []) == []
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (7, a), (7, b), (None, a + " end"), (8, b + " end"), (None, "only one"), (7, None), (7, "")]
    assert left(near.keep_one_of_group, rows) == sorted([(1, a), (7, b), (None, "only one"), (7, None), (7, "")], key=str)
    assert left(near.keep_one_of_group, []) == []


def test_language_stage_keeps_clashing_columns(spark):
    rows = [(i, "the cat and the dog and the owl", "en", "a", 1.0) for i in (1, 1, None)] + [(4, "12 34", "en", "a", 1.0), (5, None, "en", "a", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.keep_identified(spark, docs, None)
    assert got.columns == docs.columns and sorted((tuple(r) for r in got.collect()), key=str) == sorted(rows[:3], key=str)
