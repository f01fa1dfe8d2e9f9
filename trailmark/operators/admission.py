"""Validation, URL rules, quality score, sensitive content, and the admission funnel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import rules
from trailmark.functions import text as T
from trailmark.functions import urls as U
from trailmark.functions.arrays import let
from trailmark.operators import scale
from trailmark.operators.extract import auth_phrase_hits

# Field limits in characters.
VISIT_LIMITS = {"url": 8192, "title": 2048, "content": 1_000_000, "meta_description": 8192, "meta_author": 2048}
QUERY_LIMIT = 2000
TOP_K_RANGE = (1, 50)


def invalid_field(limits: dict[str, int] = VISIT_LIMITS, required: Sequence[str] = ("url",)) -> Column:
    """Name of the first field that breaks its limit, or null for a valid row."""
    checks = [F.when(F.coalesce(F.length(f), F.lit(0)) > n, F.lit(f)) for f, n in limits.items()]
    missing = [F.when(F.coalesce(F.length(f), F.lit(0)) == 0, F.lit(f)) for f in required]
    return F.coalesce(*missing, *checks)


def split_valid(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with `reject_field`."""
    marked = visits.withColumn("reject_field", invalid_field())
    return (
        marked.filter(F.col("reject_field").isNull()).drop("reject_field"),
        marked.filter(F.col("reject_field").isNotNull()),
    )


def valid_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    return queries.filter(F.length(query_col).between(1, QUERY_LIMIT))


def _any_of(parts: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in parts)


def is_web_url(url: Column) -> Column:
    return url.rlike("^https?://")


def substring_blocked(host: Column, url: Column, parts: Sequence[str] = tuple(rules.BLOCKED_URL_PARTS)) -> Column:
    """A listed part occurs in the host or anywhere in the URL."""
    listed = F.array(*[F.lit(p) for p in parts])
    return let(F.concat(host, F.lit("\n"), url), lambda both: F.exists(listed, lambda p: both.contains(p)))


def path_blocked(path: Column, patterns: Sequence[str] = rules.BLOCKED_PATHS) -> Column:
    return F.lower(path).rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def url_blocked(url: Column) -> Column:
    """The admission check on a URL: listed parts, path patterns, non-web schemes."""
    return (
        substring_blocked(F.lower(U.authority(url)), url)
        | path_blocked(U.path(url))
        | ~url.rlike("^https?://")
    )


def host_rule_blocked(host: Column, hosts: Sequence[str] = tuple(rules.CAPTURE_BLOCKED_HOSTS)) -> Column:
    """Host equals a listed name or lies below it. The list is fixed and short."""
    return host.rlike(rf"(?:^|\.)(?:{_any_of(hosts)})$")


def capture_blocked(url: Column) -> Column:
    """The stricter check applied where a visit is captured."""
    by_host = let(
        U.host(url),
        lambda host: host_rule_blocked(host) | host.rlike(_any_of(rules.CAPTURE_BLOCKED_HOST_PARTS)),
    )
    return ~is_web_url(url) | by_host | path_blocked(U.path(url), rules.CAPTURE_BLOCKED_PATHS)


def drop_user_blocked(visits: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """Removes visits whose host is, or lies below, a domain of the user's list (`domain`).

    Hosts are reduced to the distinct blocked ones first; only those meet the visits.
    """
    wanted = domains.select(U.apex(F.col("domain")).alias("suffix")).filter("suffix <> ''").distinct()
    hosts = visits.select(U.host(F.col(url_col)).alias("_host")).distinct()
    suffixes = hosts.select("_host", F.explode(U.host_suffixes(F.col("_host"))).alias("suffix"))
    blocked = scale.lookup_join(suffixes, wanted, "suffix", "left_semi", spread_by=F.col("_host"))
    blocked = blocked.select("_host").distinct()
    return scale.lookup_join(
        visits.withColumn("_host", U.host(F.col(url_col))), blocked, "_host", "left_anti", spread_by=F.col(url_col)
    ).drop("_host")


def _first_match(value: Column, table: Sequence[tuple[str, str]], regex: bool) -> Column:
    cases = [
        F.when(value.rlike(key) if regex else value.contains(key), F.lit(result)) for key, result in table
    ]
    return F.coalesce(*cases)


def with_quality(visits: DataFrame) -> DataFrame:
    """Adds `content_type, quality_points, quality_score` (points are hundredths).

    Needs `url, title, content, word_count, text_to_tag_ratio`.
    """
    host, path = F.col("_host"), F.col("_path")
    by_host = _first_match(host, rules.CONTENT_HOSTS, regex=False)
    by_path = _first_match(path, rules.CONTENT_PATHS, regex=True)
    count = F.when(
        F.coalesce("word_count", F.lit(0)) == 0, T.whitespace_words(F.col("content"))
    ).otherwise(F.col("word_count"))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    ratio = F.coalesce(F.col("text_to_tag_ratio"), F.lit(0.0))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, F.lit(n)).otherwise(F.lit(0))

    path_points = F.greatest(
        points(F.col("_by_path").isNotNull(), rules.PATH_POINTS),
        points(path.rlike("(?U)" + rules.SLUG_PATH), rules.SLUG_POINTS),
    ) + points(depth.between(2, 5), rules.DEPTH_POINTS)
    total = points(F.col("_by_host").isNotNull(), rules.HOST_POINTS) + path_points
    for limit, n in rules.WORD_BANDS:
        total = total + points(F.col("_words") >= limit, n)
    for limit, n in rules.RATIO_BANDS:
        total = total + points(ratio >= limit, n)
    total = total + points(T.whitespace_words(F.col("title")) >= 3, rules.TITLE_POINTS)
    guessed = F.when(F.col("_words") >= 300, F.lit("article")).otherwise(F.lit("other"))
    return (
        visits.withColumn("_words", count)
        .withColumn("_host", F.lower(U.authority(F.col("url"))))
        .withColumn("_path", F.lower(U.path(F.col("url"))))
        .withColumn("_blocked", url_blocked(F.col("url")))
        .withColumn("_by_host", by_host)
        .withColumn("_by_path", by_path)
        .withColumn(
            "content_type",
            F.when(F.col("_blocked"), F.lit("skip")).otherwise(F.coalesce("_by_host", "_by_path", guessed)),
        )
        .withColumn(
            "quality_points",
            F.when(F.col("_blocked"), F.lit(0)).otherwise(F.least(total, F.lit(100))).cast("long"),
        )
        .withColumn("quality_score", F.col("quality_points") / 100.0)
        .drop("_words", "_host", "_path", "_blocked", "_by_host", "_by_path")
    )


def luhn_hits(text: Column) -> Column:
    """Distinct card numbers: 13 to 19 digits that pass the Luhn check."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + rules.CARD_PATTERN), F.lit(0))
    digits = F.transform(found, lambda m: F.regexp_replace(m, "[ -]", ""))
    return F.array_distinct(
        F.filter(digits, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    )


def _distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)))


def sensitive_counts(text: Column) -> dict[str, Column]:
    """Number of distinct hits per kind."""
    return {
        "cards": F.size(luhn_hits(text)).cast("long"),
        "ssns": F.size(_distinct_matches(text, rules.SSN_PATTERN)).cast("long"),
        "ibans": F.size(_distinct_matches(text, rules.IBAN_PATTERN)).cast("long"),
        # The pattern scans slowly and most texts hold no address at all.
        "emails": F.when(
            text.contains("@"), F.size(_distinct_matches(text, rules.EMAIL_PATTERN))
        ).otherwise(F.lit(0)).cast("long"),
    }


def sensitive_reason(text: Column, word_count: Column | None = None) -> Column:
    """First matching reason for refusing a text, or null.

    On a short page one hit is enough, on a long one three distinct hits are needed.
    """
    n_words = T.whitespace_words(text)
    if word_count is not None:
        n_words = F.when(F.coalesce(word_count, F.lit(0)) > 0, word_count).otherwise(n_words)
    needed = F.when(n_words < rules.SHORT_PAGE_WORDS, F.lit(1)).otherwise(F.lit(3))
    counts = sensitive_counts(text)

    def enough(n: Column) -> Column:
        return n >= needed

    density = counts["emails"] / F.greatest(n_words, F.lit(1))
    reason = (
        F.when(enough(counts["cards"]), F.lit("pii:card"))
        .when(enough(counts["ssns"]), F.lit("pii:ssn"))
        .when(enough(counts["ibans"]), F.lit("pii:iban"))
        .when((counts["emails"] >= 5) & (density > 0.02), F.lit("pii:contact-density"))
        .when((n_words < rules.AUTH_PAGE_WORDS) & (auth_phrase_hits(text) >= 2), F.lit("auth-text"))
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, reason)


def gate_reasons(visits: DataFrame, min_points: int = rules.MIN_QUALITY) -> DataFrame:
    """Adds quality columns and `skip_reason` for the checks that need no model.

    Order: blocked URL, low quality, no content, sensitive content.
    """
    scored = with_quality(visits)
    empty = ~F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))
    return scored.withColumn(
        "skip_reason",
        F.when(F.col("content_type") == "skip", F.lit("url_blocked"))
        .when(F.col("quality_points") < min_points, F.lit("low_quality"))
        .when(empty, F.lit("empty"))
        .otherwise(sensitive_reason(F.col("content"), F.col("word_count"))),
    )


def skip_stats(skips: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """`domain, reason, count, last_seen`, merged with an existing table when given.

    Visits without content and without a domain are not counted.
    """
    fresh = (
        skips.filter((F.col("domain") != "") & (F.col("reason") != "empty"))
        .groupBy("domain", "reason")
        .agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"))
    )
    if current is None:
        return fresh
    return (
        current.unionByName(fresh)
        .groupBy("domain", "reason")
        .agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
    )


def top_skipped(stats: DataFrame, k: int = 10) -> DataFrame:
    """Domains with the most skips and their reasons."""
    return (
        stats.groupBy("domain")
        .agg(
            F.sum("count").alias("skips"),
            F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"),
        )
        .orderBy(F.desc("skips"), F.asc("domain"))
        .limit(k)
    )


def saveable_highlights(highlights: DataFrame) -> DataFrame:
    """Highlights of 5 to 2,000 characters from pages that may be captured and hold nothing sensitive.

    Needs `text, url`; a `sensitive` reason column is honoured when present.
    """
    keep = F.length(F.trim("text")).between(5, 2000) & ~capture_blocked(F.col("url"))
    if "sensitive" in highlights.columns:
        keep = keep & F.col("sensitive").isNull()
    return highlights.filter(keep)
