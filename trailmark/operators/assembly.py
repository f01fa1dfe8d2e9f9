"""Text blocks for a reader or a model: contexts, histories, digests, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import times
from trailmark.operators import scale, state

CONTEXT_CHARS = 600
ANSWER_CHARS = 200
ANSWER_RESULTS = 5
HISTORY_TURNS = 40
RULE = "\n\n---\n\n"


def _joined(rows: DataFrame, key: str, order: str, line: Column, separator: str, out: str) -> DataFrame:
    """Lines of each key in order, joined. Keys hold a handful of rows (a result list)."""
    listed = rows.select(key, order, line.alias("_line")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, "_line"))).alias("_lines")
    )
    return listed.select(key, F.array_join(F.transform("_lines", lambda x: x["_line"]), separator).alias(out))


def context_blocks(hits: DataFrame) -> DataFrame:
    """`query_id, context`: numbered sources with 600 characters of text each, sanitised."""
    line = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), T.sanitize(F.col("page_title")), F.lit("]("),
        T.sanitize(F.col("page_url")), F.lit(")\n"), T.sanitize(T.snippet(F.col("text"), CONTEXT_CHARS)),
    )
    return _joined(hits, "query_id", "rank", line, RULE, "context")


def extractive_answers(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id, answer`: a count line and the first five results, without a model."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    head = (
        queries.join(counts, "query_id", "left")
        .select(
            "query_id",
            F.concat(
                F.lit("I found "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" relevant results for: **"),
                F.col("query"), F.lit("**\n\n*(LLM unavailable - showing raw results)*\n"),
            ).alias("head"),
        )
    )
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". **["), T.sanitize(F.col("page_title")), F.lit("]("),
        T.sanitize(F.col("page_url")), F.lit(")**\n   "), T.sanitize(T.snippet(F.col("text"), ANSWER_CHARS)), F.lit("..."),
    )
    body = _joined(hits.filter(F.col("rank") <= ANSWER_RESULTS), "query_id", "rank", line, "\n", "body")
    return head.join(body, "query_id", "left").select("query_id", F.concat_ws("\n", "head", "body").alias("answer"))


def with_graph_block(contexts: DataFrame, graph_contexts: DataFrame) -> DataFrame:
    """Adds the sanitised graph block of each query, empty when it names no entity."""
    return contexts.join(graph_contexts, "query_id", "left").withColumn(
        "kg_context", T.sanitize(F.col("kg_context"))
    )


def digest_input(pages: DataFrame, as_of: Column, days: int = 7, fallback: int = 20, lines: int = 25) -> DataFrame:
    """One row `page_count, content`: pages indexed in the last week, else the newest 20, as text lines."""
    newest = [F.desc("last_visited"), F.asc("url")]
    recent = pages.filter(F.col("last_indexed") >= times.days_before(as_of, days))
    n_recent = recent.agg(F.count("*").alias("n")).scalar()
    spare = pages.orderBy(*newest).limit(fallback).filter(n_recent == 0)
    chosen = recent.orderBy(*newest).limit(lines).unionByName(spare)
    total = F.when(n_recent > 0, n_recent).otherwise(F.count("*"))
    description = F.coalesce("meta_description", F.lit(""))
    head = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("url"), F.lit(")"))
    line = F.when(description != "", F.concat(head, F.lit("\n  "), F.substring(description, 1, 120))).otherwise(head)
    # At most `lines` rows are gathered here.
    listed = chosen.select(F.unix_micros("last_visited").alias("t"), "url", line.alias("line")).agg(
        total.alias("page_count"),
        F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("o"), "url", "line"))).alias("l"),
    )
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return listed.select("page_count", T.sanitize(text).alias("content"))


def pick_pages(pages: DataFrame, urls: DataFrame | None = None, seed: str | None = None, k: int = 1) -> DataFrame:
    """`url` of the pages to make cards of: those asked for (`url`, with or without a slash at the end) that are stored,
    or else the first `k` in an order that the seed decides."""
    known = pages.select("url").distinct()
    if urls is not None:
        return state.resolve_urls(urls, known)
    order = F.md5(F.concat(F.lit(seed or ""), F.col("url")))
    return known.orderBy(order, "url").limit(k)


def card_inputs(chunks: DataFrame, first: int = 6, chars: int = 3000, pages: DataFrame | None = None) -> DataFrame:
    """`page_url, content`: the first chunks of each page, or of each of `pages` (`url`), joined and cut."""
    if pages is not None:
        chunks = scale.lookup_join(
            chunks, pages.select(F.col("url").alias("page_url")).distinct(), "page_url", "left_semi", spread_by=F.col("chunk_index")
        )
    head = scale.top_rows(
        chunks.filter(F.coalesce("text", F.lit("")) != ""), ["page_url"], [F.asc("chunk_index")], first
    )
    joined = _joined(head, "page_url", "rank", F.col("text"), "\n\n", "content")
    return joined.withColumn("content", F.substring("content", 1, chars))


# ---- conversations --------------------------------------------------------------------------


def last_turns(turns: DataFrame, k: int = HISTORY_TURNS) -> DataFrame:
    """The newest `k` turns of each conversation."""
    return scale.top_rows(turns, ["conv_id"], [F.desc("turn")], k, "age")


def retrieval_queries(turns: DataFrame, chars: int = 400) -> DataFrame:
    """`conv_id, turn, query`: each user message with the user message before it in front.

    The text is cut only when an earlier message was added.
    """
    users = turns.filter(F.col("role") == "user")
    chained = scale.carry_forward(users, ["conv_id"], F.floor(F.col("turn") / 1024), ["turn"], F.col("text"), "last_user")
    both = F.substring(F.concat_ws(" ", "last_user", "text"), 1, chars)
    return chained.select(
        "conv_id", "turn", F.when(F.col("last_user").isNotNull(), both).otherwise(F.col("text")).alias("query")
    )


def chat_histories(turns: DataFrame, k: int = HISTORY_TURNS) -> DataFrame:
    """`conv_id, messages`: the newest turns as role and content pairs, oldest first.

    Only user and assistant turns with text count; assistant text is sanitised.
    """
    spoken = turns.filter(F.col("role").isin("user", "assistant") & (F.coalesce("text", F.lit("")) != ""))
    text = F.when(F.col("role") == "assistant", T.sanitize(F.col("text"))).otherwise(F.col("text"))
    recent = last_turns(spoken.withColumn("text", text), k)
    return recent.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages")
    )
