"""Daily resurfacing of half-forgotten pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import times
from trailmark.operators import scale
from trailmark.operators.embedding import Embedder
from trailmark.plans.search import Corpus, retrieve
from trailmark.session import materialize

PICKS = 3
ANCHOR_PAGES = 5
CANDIDATES = 30
SNIPPET = 220


def forgotten_pages(pages: DataFrame, as_of: Column) -> DataFrame:
    """Pages last visited 3 to 30 days ago, or older than a day when there are none."""
    def ago(days: int) -> Column:
        return times.days_before(as_of, days)

    zone = pages.filter(F.col("last_visited").between(ago(30), ago(3)))
    n_zone = zone.agg(F.count("*").alias("n")).scalar()
    return zone.unionByName(pages.filter(F.col("last_visited") <= ago(1)).filter(n_zone == 0))


def anchor_query(pages: DataFrame, as_of: Column) -> DataFrame:
    """One `query_id, query` row: the titles of the five newest pages of the last 48 hours."""
    recent = pages.filter(F.col("last_visited") >= times.days_before(as_of, 2))
    newest = recent.orderBy(F.desc("last_visited"), F.asc("page_url")).limit(ANCHOR_PAGES)
    listed = newest.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.unix_micros("last_visited")).alias("o"), "page_url", "page_title"))
        ).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: F.coalesce(x["page_title"], F.lit(""))), " ")
    return listed.select(F.lit(0).cast("long").alias("query_id"), text.alias("query")).filter(F.trim("query") != "")


def daily_resurface(
    corpus: Corpus, embedder: Embedder, as_of: Column, seed: str = "", use_graph: bool = True
) -> DataFrame:
    """`rank, url, title, snippet, days_ago`: three forgotten pages, related to recent reading first.

    Missing picks are filled in the order of a seeded hash of the URL, so a day's choice is stable.
    """
    forgotten = forgotten_pages(corpus.pages, as_of)
    anchors = anchor_query(corpus.pages, as_of)
    hits = retrieve(corpus, anchors, embedder, as_of, CANDIDATES, use_graph)
    # One query: at most CANDIDATES rows from here on.
    old_hits = materialize(
        hits.join(forgotten.select("page_url"), "page_url", "left_semi")
    )
    best = scale.first_rows(old_hits, ["page_url"], [F.asc("rank")])
    picked = best.orderBy("rank").limit(PICKS).select(
        F.lit(0).alias("kind"), F.col("rank").cast("string").alias("at"), F.lpad(F.col("rank").cast("string"), 6, "0").alias("o"),
        "page_url", "page_title", T.snippet(F.col("text"), SNIPPET).alias("snippet"), "last_visited",
    ).drop("at")
    shuffled = F.md5(F.concat(F.lit(seed), F.col("page_url")))
    fill = (
        forgotten.join(F.broadcast(picked.select("page_url")), "page_url", "left_anti")
        .select(
            F.lit(1).alias("kind"), shuffled.alias("o"), "page_url", "page_title",
            T.snippet(F.col("meta_description") if "meta_description" in forgotten.columns else F.lit(""), SNIPPET).alias("snippet"),
            "last_visited",
        )
        .orderBy("o", "page_url")
        .limit(PICKS)
    )
    # Six rows at most.
    both = picked.unionByName(fill).withColumn("one", F.lit(1))
    ranked = scale.top_rows(both, ["one"], [F.asc("kind"), F.asc("o"), F.asc("page_url")], PICKS)
    return ranked.select(
        "rank", F.col("page_url").alias("url"), F.col("page_title").alias("title"), "snippet",
        times.whole_days_since(F.col("last_visited"), as_of).alias("days_ago"),
    )
