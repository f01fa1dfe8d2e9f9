"""Rank fusion, recency, hydration, re-ranking and one result per page."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import times
from trailmark.functions import urls as U
from trailmark.operators import scale
from trailmark.session import materialize

# Fusion constant, leg order and leg weights.
RRF_K = 60
LEGS = (("bm25", 1.0), ("dense", 1.0), ("knowledge_graph", 0.8))
RECENCY_DECAY = 0.98
RERANK_CHARS = 1500
OVERFETCH = 3

PairScorer = Callable[[Column, Column], Column]


def pool_size(k: int) -> int:
    """Candidates fetched per leg."""
    return max(5 * k, 50)


def leg(hits: DataFrame, name: str) -> DataFrame:
    """Marks ranked `query_id, chunk_id, rank` rows as one retrieval leg."""
    position = [n for n, _ in LEGS].index(name)
    return hits.select(
        "query_id", "chunk_id", "rank",
        F.lit(name).alias("source"), F.lit(position).alias("leg"), F.lit(dict(LEGS)[name]).alias("weight"),
    )


def reciprocal_rank_fusion(legs: DataFrame, pool: int) -> DataFrame:
    """`query_id, chunk_id, score, source, fused_rank`, the best `pool` per query.

    A chunk listed twice in a leg scores twice. Ties go to the earlier leg, then the better rank,
    then the smaller chunk id; the score shown is rounded to 6 digits after ranking.
    """
    fused = legs.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") * (F.lit(1.0) / (F.lit(RRF_K) + F.col("rank")))), 12).alias("raw"),
        F.min(F.struct("leg", "rank")).alias("first"),
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"),
    )
    order = [F.desc("raw"), F.asc("first.leg"), F.asc("first.rank"), F.asc("chunk_id")]
    ranked = scale.top_rows(fused, ["query_id"], order, pool, "fused_rank")
    return ranked.select("query_id", "chunk_id", F.round("raw", 6).alias("score"), "source", "fused_rank")


def hydrate(
    fused: DataFrame,
    chunks: DataFrame,
    pages: DataFrame,
    k: int,
    as_of: Column,
    decay: float = RECENCY_DECAY,
    date_from: Column | None = None,
    date_to: Column | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Adds page data to fused hits, applies the date range and recency, and cuts to `k` per query.

    Ids travel first: page keys, then page times, and the text only for the rows that are left.
    `chunks` needs `chunk_id, page_url, text`, `pages` needs `page_url, page_title, last_visited`.
    `fits` says whether the hit list was checked to be small. One that was not is written first: it is looked at
    before each join, and would be searched for anew every time.
    """
    if fits is None:
        fused = materialize(fused)
        fits = scale.is_small(fused)
    none = F.lit(None).cast("timestamp")
    located = scale.lookup_join(
        chunks.select("chunk_id", "page_url"), fused, "chunk_id", spread_by=F.col("chunk_id"), small_fits=fits
    )
    dated = scale.lookup_join(
        pages.select("page_url", "page_title", "last_visited"), located, "page_url",
        spread_by=F.col("page_url"), small_fits=fits,
    ).filter(
        times.between_dates(
            F.col("last_visited"), none if date_from is None else date_from, none if date_to is None else date_to
        )
    )
    if decay < 1.0:
        faded = F.col("score") * F.pow(F.lit(decay), times.days_since(F.col("last_visited"), as_of))
        dated = dated.withColumn("score", F.round(faded, 9))
        order = [F.desc("score"), F.asc("fused_rank")]
    else:
        order = [F.asc("fused_rank")]
    winners = scale.top_rows(dated, ["query_id"], order, k)
    return scale.lookup_join(
        chunks.select("chunk_id", "text"), winners, "chunk_id", spread_by=F.col("chunk_id"), small_fits=fits
    ).select(
        "query_id", "rank", "chunk_id", "text", "page_url", "page_title", "last_visited", "score", "source"
    )


def term_coverage(query: Column, text: Column) -> Column:
    """Default pair scorer: share of the distinct query terms found in the text."""
    wanted = F.array_distinct(T.terms(query))
    found = F.size(F.array_intersect(wanted, T.terms(text)))
    return F.when(F.size(wanted) > 0, F.round(found / F.size(wanted), 6)).otherwise(F.lit(0.0))


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    k: int,
    scorer: PairScorer = term_coverage,
    threshold: float | None = None,
    chars: int | None = RERANK_CHARS,
) -> DataFrame:
    """Re-orders ranked hits by a pair score; the former score stays as `retrieval_score`.

    The scorer sees the first `chars` characters of a text, or all of it. A null score (scorer failure) keeps the former order behind the scored hits.
    """
    text = F.coalesce("text", F.lit(""))
    seen = text if chars is None else F.substring(text, 1, chars)
    scored = hits.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", scorer(F.col("query"), seen))
    if threshold is not None:
        scored = scored.filter(F.col("rerank_score") >= threshold)
    scored = scored.drop("query").withColumnRenamed("rank", "former_rank")
    ranked = scale.top_rows(scored, ["query_id"], [F.desc_nulls_last("rerank_score"), F.asc("former_rank")], k)
    return (
        ranked.withColumn("retrieval_score", F.col("score"))
        .withColumn("score", F.coalesce("rerank_score", "score"))
        .drop("former_rank")
    )


def one_per_page(hits: DataFrame, k: int) -> DataFrame:
    """The best hit per page, then the best `k` pages per query, ranked anew."""
    keyed = hits.filter(F.coalesce("page_url", F.lit("")) != "").withColumn("_base", U.base_url(F.col("page_url")))
    first = scale.first_rows(keyed, ["query_id", "_base"], [F.asc("rank")]).drop("_base")
    return scale.top_rows(first.withColumnRenamed("rank", "_rank"), ["query_id"], [F.asc("_rank")], k).drop("_rank")


def distinct_references(hits: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """The first hit, by `rank`, of every exact `url` and `keys`; what a list of references shows."""
    return scale.first_rows(hits, [*keys, "url"], [F.asc("rank")])


def best_pages(
    hits: DataFrame, queries: DataFrame, k: int, scorer: PairScorer = term_coverage, chars: int | None = RERANK_CHARS
) -> DataFrame:
    """Re-rank three times as many hits as asked for, keep one per page, cut to `k`."""
    return one_per_page(rerank(hits, queries, k * OVERFETCH, scorer, chars=chars), k)


def search_results(hits: DataFrame, snippet_chars: int = 300) -> DataFrame:
    """The shape shown to a reader."""
    return hits.select(
        "query_id", "rank", F.col("page_url").alias("url"), F.col("page_title").alias("title"),
        T.snippet(F.col("text"), snippet_chars).alias("snippet"), F.round("score", 4).alias("score"),
        "source", F.col("last_visited").alias("timestamp"),
    )
