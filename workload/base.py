"""Table access and SQL fragments shared by the registered queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.functions import times, urls
from trailmark.operators import extract, postings, scale
from trailmark.operators.postings import PostingsIndex
from trailmark.session import scratch_root

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return times.ntz_instant(F.lit(AS_OF).cast("timestamp_ntz"))


def instant(text: str) -> Column:
    return times.ntz_instant(F.lit(text).cast("timestamp_ntz"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-chunk pages: `chunk_id, text, page_url, page_title`."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
        .alias("page_url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("page_title"),
    )


def document_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`chunk_id, last_visited`: the time of the event with the same number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("chunk_id"), times.ntz_instant(F.col("ts")).alias("last_visited")
    )


#: What searches read and several queries share, by application, tables and name.
_stored: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]) -> object:
    """What `build` derives from the tables and writes to the shared folder, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def document_index(spark: SparkSession, sf_dir: str) -> PostingsIndex:
    """The stored keyword index of the documents."""
    def build() -> PostingsIndex:
        path = f"{scratch_root(spark)}/indexes/{uuid.uuid4().hex}"
        postings.write(postings.of_chunks(scale.spread(documents(spark, sf_dir), "chunk_id")), path)
        rows = postings.read(spark, path, "bigint")
        return PostingsIndex(rows, *postings.totals(rows))

    return stored(spark, sf_dir, "document_index", build)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.spread(table(spark, sf_dir, "events"), "event_id").withColumn("ts", times.ntz_instant(F.col("ts")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with extracted text and the word count of the capture step."""
    return extract.page_text(scale.spread(table(spark, sf_dir, "pages"), "page_id")).withColumn(
        "word_count", T.content_words(F.col("content"))
    )


def page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visit per page, at the time of the event with the same number."""
    clock = events(spark, sf_dir).select(F.col("event_id").alias("page_id"), "ts")
    return pages(spark, sf_dir).join(clock, "page_id").withColumn("domain", urls.authority(F.col("url")))


def event_visits(spark: SparkSession, sf_dir: str, source: DataFrame) -> DataFrame:
    """Every event as a visit to a row of `source` (`page_no`, numbered from 0)."""
    n = source.agg(F.count("*").alias("n")).scalar()
    numbered = events(spark, sf_dir).withColumn("page_no", F.pmod(F.col("event_id"), n))
    return numbered.join(source, "page_no")


# ---- SQL fragments --------------------------------------------------------------------------

# Extracted text of `pages`, for markup without nested boilerplate.
PAGE_CTE = r"""
raw_page AS (
  SELECT page_id, url, html,
         regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title_html,
         regexp_extract(html, '(?is)<article>(.*)</article>', 1) AS article_html,
         greatest(len(regexp_extract_all(regexp_extract(html, '(?is)<body\b[^>]*>(.*)$', 1), '<[a-zA-Z]')), 1) AS n_elements
  FROM pages
), spaced AS (
  SELECT *, regexp_replace(article_html, '\s+', ' ', 'g') AS a1 FROM raw_page
), broken AS (
  SELECT *, regexp_replace(regexp_replace(a1, '<(/?)(p|h1|br|ul|li|div)(\s[^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS a2
  FROM spaced
), decoded AS (
  SELECT *,
    replace(replace(replace(replace(a2, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS a3,
    trim(regexp_replace(replace(replace(title_html, '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title
  FROM broken
), page AS (
  SELECT page_id, url, html, title, n_elements,
    regexp_replace(regexp_replace(regexp_replace(a3, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
                   '^\s+|\s+$', '', 'g') AS content
  FROM decoded
), page_full AS (
  SELECT *, round(length(content) / n_elements, 2) AS ratio,
    len(list_filter(regexp_extract_all(content, '[^\s]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))::BIGINT AS word_count
  FROM page
)
"""

def sql_authority(url: str = "url") -> str:
    return rf"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def sql_path(url: str = "url") -> str:
    return rf"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def sql_base_url(url: str = "url") -> str:
    return rf"regexp_replace(regexp_replace({url}, '[?#].*$', ''), '/+$', '')"


def sql_any(column: str, parts: list[str]) -> str:
    """OR of substring tests."""
    return "(" + " OR ".join(f"contains({column}, {quote(p)})" for p in parts) + ")"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_terms(text: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({text})), '[\p{{L}}\p{{N}}]+')"

