"""Keyword search: BM25 over a stored index (`operators.postings`) or over chunks that are searched once.

For the latter the index is partitioned by chunk: all terms of a chunk sit in one task, so per-chunk scores are
summed where the chunk is, and only the top k per query leave a task. A term that occurs in every
document is therefore never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.operators import scale
from trailmark.operators.postings import PostingsIndex
from trailmark.session import materialize

K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
# A query batch above this many distinct phrases takes the shuffled path.
MAX_BROADCAST_PHRASES = 200_000


def index_chunks(
    chunks: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    tokenizer: Callable[[Column], Column] = T.terms,
    partitions: int | None = None,
) -> DataFrame:
    """Index rows `chunk_id, tokens, length`, hash-partitioned by chunk.

    The text is shuffled once, before tokenising, so that every consumer of the index shares that
    one exchange.
    """
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(partitions, "chunk_id") if partitions else rows.repartition("chunk_id")
    return rows.select("chunk_id", tokenizer(F.col("text")).alias("tokens")).withColumn(
        "length", F.size("tokens").cast("long")
    )


def occurrences(index: DataFrame) -> DataFrame:
    """`chunk_id, length, phrase`: one row per token.

    An outer explode keeps Spark from inferring a non-empty filter that would tokenise twice.
    """
    return index.select("chunk_id", "length", F.explode_outer("tokens").alias("phrase"))


def phrase_occurrences(index: DataFrame, wanted: DataFrame, longest: int, fits: bool | None = None) -> DataFrame:
    """`chunk_id, length, phrase`: one row per occurrence of a phrase of `wanted`.

    Every position carries the run of tokens that starts there; a phrase meets the positions of its
    first token and is compared with the run.
    """
    starts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1))),
        lambda i: F.struct(
            F.get("tokens", i - 1).alias("head"), F.array_join(F.slice("tokens", i, F.lit(longest)), " ").alias("run")
        ),
    )
    positions = index.select("chunk_id", "length", F.explode_outer(starts).alias("p")).select(
        "chunk_id", "length", F.col("p.head").alias("head"), F.col("p.run").alias("run")
    )
    keyed = wanted.withColumn("head", F.substring_index("phrase", " ", 1))
    met = scale.lookup_join(positions, keyed, "head", spread_by=F.struct("chunk_id", "run"), small_fits=fits)
    same = F.concat("run", F.lit(" ")).startswith(F.concat("phrase", F.lit(" ")))
    return met.filter(same).select("chunk_id", "length", "phrase")


def postings(
    index: DataFrame, only: DataFrame | None = None, longest: int = 1, only_fits: bool | None = None
) -> DataFrame:
    """`chunk_id, length, phrase, tf`: all terms, or the phrases of `only` (up to `longest` tokens).

    The input partitioning by chunk already clusters the keys, so counting needs no shuffle.
    """
    if only is None:
        found = occurrences(index).filter(F.col("phrase").isNotNull())
    elif longest > 1:
        found = phrase_occurrences(index, only, longest, only_fits)
    else:
        found = scale.lookup_join(
            occurrences(index), only, "phrase", "left_semi", spread_by=F.col("chunk_id"), small_fits=only_fits
        )
    return found.groupBy("chunk_id", "length", "phrase").agg(F.count("*").alias("tf"))


def term_statistics(index: DataFrame) -> DataFrame:
    """Document frequency and total occurrences per term."""
    return postings(index).groupBy("phrase").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences")
    ).withColumnRenamed("phrase", "term")


def query_phrases(
    queries: DataFrame,
    query_col: str = "query",
    tokenizer: Callable[[Column], Column] = T.terms,
) -> DataFrame:
    """`query_id, phrase, n_tokens, weight`: the OR-joined parts of a query.

    A query is cut at blanks; parts of one character are ignored, quotes are dropped, and a part
    with inner punctuation becomes a phrase of its tokens. A repeated part counts again.
    """
    parts = F.filter(T.words(F.col(query_col)), lambda w: F.length(w) > 1)
    exploded = queries.select("query_id", F.explode(parts).alias("part"))
    tokens = tokenizer(F.replace(F.col("part"), F.lit('"'), F.lit("")))
    return (
        exploded.select("query_id", tokens.alias("tokens"))
        .filter(F.size("tokens") > 0)
        .select("query_id", F.array_join("tokens", " ").alias("phrase"), F.size("tokens").alias("n_tokens"))
        .groupBy("query_id", "phrase", "n_tokens")
        .agg(F.count("*").alias("weight"))
    )


def phrase_rows(queries: DataFrame, phrase_col: str, tokenizer: Callable[[Column], Column] = T.terms) -> DataFrame:
    """Like query_phrases, with the whole column taken as one phrase."""
    return (
        queries.select("query_id", tokenizer(F.col(phrase_col)).alias("tokens"))
        .filter(F.size("tokens") > 0)
        .select(
            "query_id",
            F.array_join("tokens", " ").alias("phrase"),
            F.size("tokens").alias("n_tokens"),
            F.lit(1).cast("long").alias("weight"),
        )
    )


def phrase_lengths(phrases: DataFrame) -> list[int]:
    """The distinct token counts in a batch: bounded by the query length limit."""
    found = phrases.agg(F.sort_array(F.collect_set("n_tokens")).alias("n")).first()["n"]
    return list(found) or [1]


def bm25(
    index: DataFrame | PostingsIndex,
    phrases: DataFrame,
    k: int,
    digits: int = 6,
    max_broadcast: int = MAX_BROADCAST_PHRASES,
) -> DataFrame:
    """Top-k chunks per query: `query_id, chunk_id, score, rank`. `index` is a stored index, or one made by
    `index_chunks` for a corpus that is searched once.

    Ranked by the score rounded to `digits`, then chunk id, so that the order does not depend on
    the order of summation.
    """
    # One look at the batch: its size bounds every table derived from it.
    batch = phrases.agg(F.count("*").alias("n"), F.max("n_tokens").alias("longest")).first()
    fits = batch["n"] <= max_broadcast
    wanted = phrases.select("phrase").distinct()
    if isinstance(index, PostingsIndex):
        # Read twice, so written. By chunk, before a count meets all the queries that ask for it: their scores
        # then add up where they are.
        counted = materialize(index.counts(wanted, fits and batch["n"] * (batch["longest"] or 1) <= max_broadcast))
        by_chunk = counted.repartition("chunk_id")
        n_chunks, avg_length = F.lit(index.n_chunks), F.lit(index.total_length / max(1, index.n_chunks))
    else:
        # Texts are cut into tokens once. An empty token, which no text has, stands first in every chunk: its
        # rows hold the lengths of all chunks.
        marked = index.withColumn("tokens", F.concat(F.array(F.lit("")), "tokens"))
        asked = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit("").alias("phrase")))
        rows = materialize(postings(marked, asked, batch["longest"] or 1, fits))
        n, total = rows.filter(F.col("phrase") == "").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        counted = rows.filter(F.col("phrase") != "")
        by_chunk = counted.repartition("chunk_id")
        n_chunks, avg_length = F.lit(n), F.lit(total / max(1, n))

    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    frequencies = (
        counted.groupBy("phrase").agg(F.count("*").alias("df"))
        .withColumn("n", n_chunks)
        .select("phrase", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))
    )
    weighted = phrases.join(frequencies, "phrase").select(
        "query_id", "phrase", (F.col("idf") * F.col("weight")).alias("boost")
    )
    matched = scale.lookup_join(
        by_chunk, weighted, "phrase", spread_by=F.col("chunk_id"), small_fits=fits
    )
    tf = F.col("tf").cast("double")
    saturation = tf + K1 * (1 - B + B * F.col("length") / avg_length)
    scores = (
        matched.withColumn("part", F.col("boost") * tf * (K1 + 1) / saturation)
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum("part"), digits).alias("score"))
    )
    return scale.top_rows(scores, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 10, **columns: str) -> DataFrame:
    """Index a chunk table and answer a batch of `query_id, query` rows."""
    return bm25(index_chunks(chunks, **columns), query_phrases(queries), k)
