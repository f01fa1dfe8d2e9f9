import pytest
from pyspark.sql import functions as F

from trailmark.functions.stemming import stem, stemmed_terms
from trailmark.operators import lexical


# Examples of the published paper.
@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"),
        ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("vietnamization", "vietnam"),
        ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"), ("formaliti", "formal"),
        ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("replacement", "replac"), ("adjustment", "adjust"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"),
        ("controll", "control"), ("roll", "roll"), ("generalizations", "gener"), ("oscillators", "oscil"),
        ("é", "é"), ("x2", "x2"),
    ],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_stemmed_search_finds_other_forms(spark):
    chunks = spark.createDataFrame([(1, "Running motors"), (2, "A quiet garden"), (3, "other text"), (4, "more words")], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "motor run")], "query_id int, query string")
    index = lexical.index_chunks(chunks, tokenizer=stemmed_terms)
    assert index.filter("chunk_id = 1").first().tokens == ["run", "motor"]
    hits = lexical.bm25(index, lexical.query_phrases(queries, tokenizer=stemmed_terms), 5)
    assert [r.chunk_id for r in hits.collect()] == [1]
    plain = lexical.bm25(lexical.index_chunks(chunks), lexical.query_phrases(queries), 5)
    assert plain.select(F.count("*")).first()[0] == 0


def test_a_search_cuts_texts_once(spark):
    chunks = spark.createDataFrame([(1, "Running motors"), (2, ""), (3, None), (4, "motor, run on")], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "motor run"), (2, "run-on")], "query_id int, query string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    index = lexical.index_chunks(chunks, tokenizer=stemmed_terms)
    watched = index.mapInPandas(counted, index.schema)
    hits = lexical.bm25(watched, lexical.query_phrases(queries, tokenizer=stemmed_terms), 5).collect()
    assert sorted((r.query_id, r.chunk_id) for r in hits) == [(1, 1), (1, 4), (2, 4)]
    assert seen.value == 4
