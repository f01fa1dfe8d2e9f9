"""Table-to-table jobs: page state, chunk and vector replacement, retention, notes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import times
from trailmark.functions import urls as U
from trailmark.operators import scale

# Page columns that change only when the content changes.
CONTENT_COLUMNS = (
    "title", "domain", "content_type", "content_hash", "quality_score", "word_count",
    "meta_description", "meta_author",
)
RETENTION_DAYS = 120


def classify_visits(visits: DataFrame, pages: DataFrame, segment: str = "hour") -> DataFrame:
    """Adds `change`: new, changed or unchanged, replaying each URL's visits in time order.

    Each visit is compared with the one before it; only the first visit of a URL in the batch needs
    the stored page, so a popular URL never meets the page table more than once. `segment` is the
    span of one URL's visits that a single task replays: "minute" for very busy URLs.
    """
    span = F.date_trunc(segment, "ts")
    chained = scale.carry_forward(visits, ["url"], span, ["ts", "visit_id"], F.col("content_hash"), "prev_hash")
    later = chained.filter(F.col("prev_hash").isNotNull()).withColumn(
        "change", F.when(F.col("content_hash") != F.col("prev_hash"), F.lit("changed")).otherwise(F.lit("unchanged"))
    )
    stored = pages.select("url", F.coalesce("content_hash", F.lit("")).alias("stored_hash"))
    first = (
        chained.filter(F.col("prev_hash").isNull())
        .join(stored, "url", "left")
        .withColumn(
            "change",
            F.when(F.col("stored_hash").isNull(), F.lit("new"))
            .when(F.col("content_hash") != F.col("stored_hash"), F.lit("changed"))
            .otherwise(F.lit("unchanged")),
        )
        .drop("stored_hash")
    )
    return first.unionByName(later).drop("prev_hash")


def upsert_pages(classified: DataFrame, pages: DataFrame) -> DataFrame:
    """The next page snapshot. Visits are reduced per URL before they meet the stored pages.

    Content columns and last_indexed follow the last new or changed visit; an unchanged visit moves
    only visit_count and last_visited.
    """
    at = F.struct("ts", "visit_id")
    changed = F.col("change") != "unchanged"
    batch = classified.groupBy("url").agg(
        F.count("*").alias("b_count"),
        F.min("ts").alias("b_first"),
        F.max("ts").alias("b_last"),
        F.max(F.when(changed, F.col("ts"))).alias("b_indexed"),
        F.max_by(F.struct(*CONTENT_COLUMNS), F.when(changed, at)).alias("b_content"),
    )
    joined = pages.join(batch, "url", "full_outer")
    indexed = F.col("b_indexed").isNotNull()
    return joined.select(
        "url",
        *[F.when(indexed, F.col(f"b_content.{c}")).otherwise(F.col(c)).alias(c) for c in CONTENT_COLUMNS],
        (F.coalesce("visit_count", F.lit(0)) + F.coalesce("b_count", F.lit(0))).alias("visit_count"),
        F.coalesce("first_visited", "b_first").alias("first_visited"),
        F.greatest("last_visited", "b_last").alias("last_visited"),
        F.coalesce("b_indexed", "last_indexed").alias("last_indexed"),
    )


def versions_to_index(classified: DataFrame) -> DataFrame:
    """`url, visit_id`: the visit whose content each new or changed page now holds."""
    return (
        classified.filter(F.col("change") != "unchanged")
        .groupBy("url")
        .agg(F.max_by("visit_id", F.struct("ts", "visit_id")).alias("visit_id"))
    )


def replace_chunks(chunks: DataFrame, changed_urls: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of changed pages are dropped, new ones added."""
    gone = changed_urls.select(F.col("url").alias("page_url")).distinct()
    return chunks.join(gone, "page_url", "left_anti").unionByName(new_chunks)


def resolve_urls(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """`url` keys to act on: the requested URL when stored, else its trailing-slash variant when stored."""
    known = pages.select("url")
    exact = requested.select("url").distinct().join(known, "url", "left_semi")
    other = (
        requested.select("url").distinct().join(known, "url", "left_anti")
        .select(U.slash_variant(F.col("url")).alias("url")).distinct()
        .join(known, "url", "left_semi")
    )
    return exact.unionByName(other).distinct()


def drop_pages(tables: dict[str, DataFrame], urls: DataFrame) -> dict[str, DataFrame]:
    """Removes pages with their chunks, vectors and per-page entity pairs.

    `tables` may hold `pages` (url), `chunks` (page_url, chunk_id), `vectors` (chunk_id) and
    `pairs` (page_url); every other table is returned as it is.
    """
    gone = urls.select("url").distinct()
    by_page = gone.withColumnRenamed("url", "page_url")
    out = dict(tables)
    out["pages"] = tables["pages"].join(gone, "url", "left_anti")
    if "chunks" in tables:
        lost = tables["chunks"].join(by_page, "page_url", "left_semi").select("chunk_id")
        out["chunks"] = tables["chunks"].join(by_page, "page_url", "left_anti")
        if "vectors" in tables:
            out["vectors"] = tables["vectors"].join(lost, "chunk_id", "left_anti")
    if "pairs" in tables:
        out["pairs"] = tables["pairs"].join(by_page, "page_url", "left_anti")
    return out


def pages_of_domain(pages: DataFrame, domain: str) -> DataFrame:
    """`url` of every page on the domain or below it."""
    wanted = F.regexp_replace(F.lower(F.lit(domain)), r"^www\.", "")
    return pages.filter(U.host_matches(U.host(F.col("url")), wanted)).select("url")


def expired_pages(pages: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """`url` of pages last visited before the retention limit; none when `days` is 0 or less."""
    if days <= 0:
        return pages.select("url").limit(0)
    return pages.filter(F.col("last_visited") < times.days_before(as_of, days)).select("url")


def clear_content(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("skip_stats", "meta")) -> dict[str, DataFrame]:
    """Empties every table but the skip counters and metadata."""
    return {name: df if name in keep else df.limit(0) for name, df in tables.items()}


# ---- reads ----------------------------------------------------------------------------------


def newest_first(pages: DataFrame) -> DataFrame:
    return pages.orderBy(F.desc("last_visited"), F.asc("url"))


def recent_pages(pages: DataFrame, annotations: DataFrame, k: int = 6) -> DataFrame:
    """The newest pages with their note, when there is one."""
    return newest_first(pages).limit(k).join(annotations.select("url", "note"), "url", "left")


def pages_by_url(pages: DataFrame, urls: DataFrame) -> DataFrame:
    return scale.lookup_join(pages, urls.select("url").distinct(), "url", "left_semi", spread_by=F.col("url"))


def page_chunks(chunks: DataFrame, urls: DataFrame) -> DataFrame:
    """Chunks of the given pages in reading order."""
    wanted = urls.select(F.col("url").alias("page_url")).distinct()
    return scale.lookup_join(chunks, wanted, "page_url", "left_semi", spread_by=F.col("chunk_id")).orderBy(
        "page_url", "chunk_index"
    )


def chunks_with_page(chunks: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks by id with the URL and title of their page."""
    wanted = scale.lookup_join(chunks, ids.select("chunk_id").distinct(), "chunk_id", "left_semi", spread_by=F.col("chunk_id"))
    return wanted.join(pages.select(F.col("url").alias("page_url"), F.col("title").alias("page_title")), "page_url")


def reference_list(pages: DataFrame) -> DataFrame:
    """The most recently visited variant per URL without query and fragment."""
    keyed = pages.withColumn("base_url", U.without_query(F.col("url")))
    return scale.first_rows(keyed, ["base_url"], [F.desc("last_visited"), F.asc("url")])


def chunk_counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds `chunk_count`; chunks are counted per page before the join."""
    counts = chunks.groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("chunk_count"))
    return pages.join(counts, "url", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))


def corpus_stats(pages: DataFrame, chunks: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals."""
    def n(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    return pages.agg(F.count("*").alias("total_pages"), F.max("last_indexed").alias("last_indexed")).select(
        "total_pages", n(chunks).alias("total_chunks"), n(entities).alias("total_entities"),
        n(edges).alias("total_relations"), "last_indexed",
    )


def top_domains(pages: DataFrame, k: int = 10) -> DataFrame:
    return (
        pages.groupBy("domain")
        .agg(F.count("*").alias("pages"), F.sum("visit_count").alias("visits"))
        .orderBy(F.desc("pages"), F.desc("visits"), F.asc("domain"))
        .limit(k)
    )


# ---- highlights and notes -------------------------------------------------------------------


def highlights_latest(highlights: DataFrame, k: int | None = None) -> DataFrame:
    """The newest `k` highlights, or all of them, unordered, without `k`."""
    return highlights if k is None else highlights.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def delete_highlights(highlights: DataFrame, ids: DataFrame) -> DataFrame:
    return highlights.join(ids.select("id").distinct(), "id", "left_anti")


def upsert_annotations(current: DataFrame, notes: DataFrame) -> DataFrame:
    """`url, note, created_at, updated_at`: the latest note per URL, keeping its first time.

    `notes` has `url, note, ts, seq`; equal times are settled by `seq`.
    """
    old = current.select(
        "url", F.col("created_at").alias("first"), F.col("updated_at").alias("ts"), F.lit(-1).cast("long").alias("seq"), "note"
    )
    new = notes.select("url", F.col("ts").alias("first"), "ts", F.col("seq").cast("long"), "note")
    return (
        old.unionByName(new)
        .groupBy("url")
        .agg(
            F.max_by("note", F.struct("ts", "seq")).alias("note"),
            F.min("first").alias("created_at"),
            F.max("ts").alias("updated_at"),
        )
    )


def annotations_latest(annotations: DataFrame) -> DataFrame:
    return annotations.orderBy(F.desc("updated_at"), F.asc("url"))


def delete_annotations(annotations: DataFrame, urls: DataFrame) -> DataFrame:
    return annotations.join(urls.select("url").distinct(), "url", "left_anti")
