"""Batched hybrid retrieval: keyword, vector and graph legs in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import urls as U
from trailmark.operators import admission, embedding, entities, fusion, lexical, scale
from trailmark.operators.embedding import Embedder
from trailmark.operators.postings import PostingsIndex
from trailmark.session import materialize

GRAPH_ENTITIES = 3
# Characters of title and text that stand for a page without vectors.
FALLBACK_CHARS = 1200


@dataclass
class Corpus:
    """The tables retrieval reads.

    `chunks`: chunk_id, page_url, text. `pages`: page_url, page_title, last_visited. `vectors`:
    chunk_id, vector. `entities`: key, name, entity_type, frequency (only for the graph leg).
    `index` is the stored keyword index; without one the chunks are tokenised for the search. `tokenizer` cuts
    chunks and queries alike: `stemming.stemmed_terms` also finds other forms of an English word.
    """

    chunks: DataFrame
    pages: DataFrame
    vectors: DataFrame
    entities: DataFrame | None = None
    index: PostingsIndex | None = None
    tokenizer: Callable[[Column], Column] = T.terms

    def keyword_index(self) -> PostingsIndex | DataFrame:
        if self.index is not None:
            return self.index
        return lexical.index_chunks(self.chunks, tokenizer=self.tokenizer)


def keyword_leg(corpus: Corpus, queries: DataFrame, pool: int) -> DataFrame:
    return lexical.bm25(corpus.keyword_index(), lexical.query_phrases(queries, tokenizer=corpus.tokenizer), pool)


def dense_leg(corpus: Corpus, queries: DataFrame, embedder: Embedder, pool: int, model: str = "") -> DataFrame:
    return embedding.nearest(embedding.embed_queries(queries, embedder, model), corpus.vectors, pool)


def _named_entities(corpus: Corpus, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The longest entities of each query, and one phrase per entity, however many queries name it."""
    named = materialize(entities.match_queries(queries, corpus.entities, GRAPH_ENTITIES))
    wanted = named.select(F.col("key").alias("query_id"), "name").groupBy("query_id").agg(F.min("name").alias("name"))
    return named, lexical.phrase_rows(wanted, "name", corpus.tokenizer)


def _list_hits(named: DataFrame, found: DataFrame, pool: int) -> DataFrame:
    """The hit lists of a query's entities, one after the other; a chunk may appear twice."""
    listed = named.join(found, "key")
    order = [F.asc("ent_rank"), F.asc("hit_rank")]
    ranked = scale.top_rows(listed, ["query_id"], order, GRAPH_ENTITIES * pool)
    return ranked.select("query_id", "chunk_id", F.lit(0.5).alias("score"), "rank")


def graph_leg(corpus: Corpus, queries: DataFrame, pool: int) -> DataFrame:
    """Phrase search for the three longest entities of a query."""
    named, phrases = _named_entities(corpus, queries)
    found = lexical.bm25(corpus.keyword_index(), phrases, pool)
    return _list_hits(
        named, found.select(F.col("query_id").alias("key"), "chunk_id", F.col("rank").alias("hit_rank")), pool
    )


def keyword_and_graph_legs(corpus: Corpus, queries: DataFrame, pool: int) -> tuple[DataFrame, DataFrame]:
    """Both legs from one search of the index: queries and entities are told apart by a prefix."""
    kind = queries.schema["query_id"].dataType
    named, entity_phrases = _named_entities(corpus, queries)

    def marked(phrases: DataFrame, prefix: str) -> DataFrame:
        return phrases.withColumn("query_id", F.concat(F.lit(prefix), F.col("query_id").cast("string")))

    asked = lexical.query_phrases(queries, tokenizer=corpus.tokenizer)
    both = marked(asked, "q:").unionByName(marked(entity_phrases, "e:"))
    # At most `pool` rows per query and entity.
    found = materialize(lexical.bm25(corpus.keyword_index(), both, pool))
    own_id = F.expr("substring(query_id, 3)")
    keyword = found.filter(F.col("query_id").startswith("q:")).withColumn("query_id", own_id.cast(kind))
    by_entity = found.filter(F.col("query_id").startswith("e:")).select(
        own_id.alias("key"), "chunk_id", F.col("rank").alias("hit_rank")
    )
    return keyword, _list_hits(named, by_entity, pool)


def fuse(corpus: Corpus, queries: DataFrame, embedder: Embedder, pool: int, use_graph: bool, model: str = "") -> DataFrame:
    if use_graph:
        keyword, graph = keyword_and_graph_legs(corpus, queries, pool)
    else:
        keyword, graph = keyword_leg(corpus, queries, pool), None
    legs = fusion.leg(keyword, "bm25").unionByName(
        fusion.leg(dense_leg(corpus, queries, embedder, pool, model), "dense")
    )
    if graph is not None:
        legs = legs.unionByName(fusion.leg(graph, "knowledge_graph"))
    return fusion.reciprocal_rank_fusion(legs, pool)


def retrieve(
    corpus: Corpus,
    queries: DataFrame,
    embedder: Embedder,
    as_of: Column,
    k: int = 10,
    use_graph: bool = True,
    decay: float = fusion.RECENCY_DECAY,
    date_from: Column | None = None,
    date_to: Column | None = None,
    model: str = "",
) -> DataFrame:
    """Hybrid retrieval for a batch of `query_id, query` rows: the best `k` chunks per query."""
    pool = fusion.pool_size(k)
    use_graph = use_graph and corpus.entities is not None
    fits = scale.is_small(queries, scale.BROADCAST_ROWS // pool)
    fused = fuse(corpus, queries, embedder, pool, use_graph, model)
    return fusion.hydrate(fused, corpus.chunks, corpus.pages, k, as_of, decay, date_from, date_to, fits)


def answer_pages(
    corpus: Corpus,
    queries: DataFrame,
    embedder: Embedder,
    as_of: Column,
    k: int = 5,
    retrieve_k: int = 10,
    scorer: fusion.PairScorer = fusion.term_coverage,
    **options,
) -> DataFrame:
    """Retrieval, re-ranking and one hit per page: what a question gets back.

    Queries outside the length limits get nothing; `k` must be in TOP_K_RANGE.
    """
    low, high = admission.TOP_K_RANGE
    if not low <= k <= high:
        raise ValueError(f"k must be from {low} to {high}")
    queries = admission.valid_queries(queries)
    hits = retrieve(corpus, queries, embedder, as_of, retrieve_k, **options)
    return fusion.best_pages(hits, queries, k, scorer)


def related_pages(
    anchors: DataFrame,
    chunk_pages: DataFrame,
    vectors: DataFrame,
    floor: float = 0.65,
    fallback: DataFrame | None = None,
    embedder: Embedder | None = None,
    fallback_chars: int = FALLBACK_CHARS,
) -> DataFrame:
    """The most similar page of another site per anchor `url`: `url, page_url, chunk_id, similarity`.

    A page is represented by the centroid of its chunk vectors; a page without vectors by its
    embedded title and opening text when `fallback` (`url, title, content`) is given. Nothing is
    returned below `floor`. `chunk_pages` maps `chunk_id` to `page_url`.
    """
    wanted = anchors.select("url").distinct()
    own = scale.lookup_join(
        chunk_pages.select("chunk_id", F.col("page_url").alias("url")), wanted, "url", "left_semi",
        spread_by=F.col("chunk_id"),
    )
    own_vectors = own.join(vectors.select("chunk_id", "vector"), "chunk_id")
    centres = embedding.centroids(own_vectors, "url").select("url", F.col("vector").cast("array<double>").alias("vector"))
    if fallback is not None:
        text = F.substring(F.trim(F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("content", F.lit("")))), 1, fallback_chars)
        missing = fallback.join(own.select("url").distinct(), "url", "left_anti").withColumn("t", text).filter("t <> ''")
        centres = centres.unionByName(
            missing.select("url", embedder.vector(F.col("t")).cast("array<double>").alias("vector"))
        )
    # The page itself is on its own site, so leaving out the site leaves out both, before the best is taken.
    located = vectors.select("chunk_id", "vector").join(chunk_pages.select("chunk_id", "page_url"), "chunk_id").select(
        "chunk_id", "vector", U.authority(F.col("page_url")).alias("site")
    )
    asked = centres.select(F.col("url").alias("query_id"), "vector", U.authority(F.col("url")).alias("site"))
    best = embedding.nearest(asked, located, 1, apart="site").filter(F.col("score") >= floor)
    return best.join(chunk_pages.select("chunk_id", "page_url"), "chunk_id").select(
        F.col("query_id").alias("url"), "page_url", "chunk_id", F.col("score").alias("similarity")
    )
