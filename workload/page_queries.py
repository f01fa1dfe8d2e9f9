"""Queries over `pages` and `documents`: URLs, extraction, rules, quality, sensitive content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import rules
from trailmark.functions import text as T
from trailmark.functions import times, urls
from trailmark.operators import admission, extract, fusion, scale, state
from workload import base
from workload.base import PAGE_CTE, quote, sql_any, sql_authority, sql_base_url, sql_path

HOST_SQL = rf"lower(regexp_replace(regexp_replace({sql_authority()}, '^.*@', ''), ':\d*$', ''))"


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return base.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.authority(url).alias("domain"),
        urls.path(url).alias("path"),
        urls.apex(urls.host(url)).alias("site"),
        urls.base_url(url).alias("base_url"),
        urls.without_query(url).alias("reference_url"),
        urls.slash_variant(url).alias("slash_variant"),
    )


URL_PARTS = rf"""
SELECT page_id, {sql_authority()} AS domain, {sql_path()} AS path,
  regexp_replace({HOST_SQL}, '^www\.', '') AS site,
  {sql_base_url()} AS base_url, regexp_replace(url, '[?#].*$', '') AS reference_url,
  CASE WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url || '/' END AS slash_variant
FROM pages
"""


def base_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = base.table(spark, sf_dir, "pages").select("page_id", "url", urls.base_url(F.col("url")).alias("base_url"))
    return scale.first_rows(keyed, ["base_url"], [F.asc("page_id")])


BASE_URL_DEDUP = f"""
SELECT page_id, url, base_url FROM (
  SELECT page_id, url, {sql_base_url()} AS base_url,
         row_number() OVER (PARTITION BY {sql_base_url()} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1
"""


def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = base.event_visits(
        spark, sf_dir, base.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_no"), "url")
    )
    counted = visits.groupBy("url").agg(F.max("ts").alias("last_visited"), F.count("*").alias("visit_count"))
    return state.reference_list(counted).select(
        "url", "base_url", F.unix_micros("last_visited").alias("last_visited"), "visit_count"
    )


REFERENCE_LIST = r"""
WITH v AS (
  SELECT p.url, max(e.ts) AS lv, count(*)::BIGINT AS visit_count
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) GROUP BY 1),
r AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS base_url FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY base_url ORDER BY lv DESC, url) AS rn FROM r)
SELECT url, base_url, epoch_us(lv) AS last_visited, visit_count FROM n WHERE rn = 1
"""


def exact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the first visit to every exact URL."""
    pages = base.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_no"), "url")
    visits = base.event_visits(spark, sf_dir, pages).withColumn("rank", F.struct("ts", "event_id"))
    return fusion.distinct_references(visits, ["user_id"]).select("user_id", "url", "event_id", "event_type")


EXACT_REFERENCES = """
SELECT user_id, p.url, min_by(event_id, (ts, event_id)) AS event_id, min_by(event_type, (ts, event_id)) AS event_type
FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) GROUP BY 1, 2
"""


def visit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits, _ = admission.split_valid(base.page_visits(spark, sf_dir))
    return visits.filter(F.col("word_count") >= rules.MIN_PAGE_WORDS).select(
        "page_id", "url", "title", "word_count", "text_to_tag_ratio",
        F.length("content").cast("long").alias("content_chars"), F.unix_micros("ts").alias("ts"),
    )


VISIT_RECORDS = f"""
WITH {PAGE_CTE}
SELECT p.page_id, p.url, p.title, p.word_count, p.ratio AS text_to_tag_ratio,
       length(content)::BIGINT AS content_chars, epoch_us(e.ts) AS ts
FROM page_full p JOIN events e ON e.event_id = p.page_id
WHERE length(p.url) BETWEEN 1 AND 8192 AND length(p.title) <= 2048 AND length(p.content) <= 1000000
  AND p.word_count >= 50
"""


def visit_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents checked against tight limits, so that the given texts exercise both outcomes."""
    docs = base.documents(spark, sf_dir).select("chunk_id", F.col("page_url").alias("url"), F.col("text").alias("content"))
    reason = admission.invalid_field({"url": 32, "content": 20_000})
    return docs.withColumn("reject_field", reason).filter(F.col("reject_field").isNotNull()).select(
        "chunk_id", "reject_field"
    )


VISIT_REJECTS = """
WITH d AS (SELECT doc_id AS chunk_id, text, 'https://' || source || '.example.com/' || lang || '/' || doc_id AS url FROM documents)
SELECT chunk_id, CASE WHEN length(url) > 32 THEN 'url' ELSE 'content' END AS reject_field
FROM d WHERE length(url) > 32 OR length(text) > 20000
"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.pages(spark, sf_dir).select("page_id", "title", "content")


PAGE_TEXT = f"WITH {PAGE_CTE} SELECT page_id, title, content FROM page_full"


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.pages(spark, sf_dir).select(
        "page_id", "title", "meta_description", "meta_author", T.content_hash(F.col("content")).alias("content_hash")
    )


PAGE_METADATA = f"""
WITH {PAGE_CTE} SELECT page_id, title, '' AS meta_description, '' AS meta_author,
  left(sha256(content), 16) AS content_hash FROM page_full
"""


def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.pages(spark, sf_dir).select(
        "page_id", "word_count", T.whitespace_words(F.col("content")).alias("words"), "text_to_tag_ratio"
    )


TEXT_DENSITY = rf"""
WITH {PAGE_CTE} SELECT page_id, word_count, len(regexp_extract_all(content, '[^\s]+'))::BIGINT AS words,
  ratio AS text_to_tag_ratio FROM page_full
"""


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return base.table(spark, sf_dir, "pages").select(
        "page_id",
        admission.is_web_url(url).alias("is_web"),
        admission.capture_blocked(url).alias("capture_blocked"),
        admission.url_blocked(url).alias("admission_blocked"),
        admission.path_blocked(urls.path(url)).alias("path_blocked"),
    )


def _sql_paths(patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches(lower({sql_path()}), {quote(joined)})"


def _sql_hosts(hosts) -> str:
    return "(" + " OR ".join(f"{HOST_SQL} = {quote(h)} OR {HOST_SQL} LIKE {quote('%.' + h)}" for h in hosts) + ")"


ADMISSION_BLOCKED = (
    f"({sql_any(f'lower({sql_authority()})', rules.BLOCKED_URL_PARTS)} OR {sql_any('url', rules.BLOCKED_URL_PARTS)}"
    f" OR {_sql_paths(rules.BLOCKED_PATHS)} OR NOT regexp_matches(url, '^https?://'))"
)
CAPTURE_BLOCKED = (
    f"(NOT regexp_matches(url, '^https?://') OR {_sql_hosts(rules.CAPTURE_BLOCKED_HOSTS)}"
    f" OR {sql_any(HOST_SQL, rules.CAPTURE_BLOCKED_HOST_PARTS)} OR {_sql_paths(rules.CAPTURE_BLOCKED_PATHS)})"
)
URL_RULES = f"""
SELECT page_id, regexp_matches(url, '^https?://') AS is_web, {CAPTURE_BLOCKED} AS capture_blocked,
  {ADMISSION_BLOCKED} AS admission_blocked, {_sql_paths(rules.BLOCKED_PATHS)} AS path_blocked FROM pages
"""


def user_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages left after blocking every site whose first listed page is spam-like, by its apex name."""
    pages = base.table(spark, sf_dir, "pages")
    domains = pages.filter(F.col("url").contains("-")).select(urls.host(F.col("url")).alias("domain")).distinct()
    return admission.drop_user_blocked(pages, domains).select("page_id", "url")


USER_BLOCKLIST = rf"""
WITH h AS (SELECT page_id, url, {HOST_SQL} AS host FROM pages),
d AS (SELECT DISTINCT regexp_replace(host, '^www\.', '') AS domain FROM h WHERE url LIKE '%-%')
SELECT page_id, url FROM h WHERE NOT EXISTS (
  SELECT 1 FROM d WHERE h.host = d.domain OR h.host LIKE '%.' || d.domain)
"""


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.with_quality(base.pages(spark, sf_dir)).select(
        "page_id", "content_type", "quality_points", "quality_score"
    )


def _sql_first(value: str, pairs, regex: bool) -> str:
    test = "regexp_matches({v}, {k})" if regex else "contains({v}, {k})"
    whens = " ".join(f"WHEN {test.format(v=value, k=quote(k))} THEN {quote(t)}" for k, t in pairs)
    return f"CASE {whens} END"


QUALITY_CTE = rf"""
{PAGE_CTE}, matched AS (
  SELECT *, {ADMISSION_BLOCKED} AS blocked,
    {_sql_first(f'lower({sql_authority()})', rules.CONTENT_HOSTS, False)} AS by_host,
    {_sql_first(f'lower({sql_path()})', rules.CONTENT_PATHS, True)} AS by_path,
    regexp_matches(lower({sql_path()}), '/[\p{{L}}\p{{N}}_]+(?:-[\p{{L}}\p{{N}}_]+)+') AS slug,
    len(list_filter(string_split(lower({sql_path()}), '/'), lambda s: s <> '')) AS depth,
    CASE WHEN word_count = 0 THEN len(regexp_extract_all(content, '[^\s]+')) ELSE word_count END AS n,
    len(regexp_extract_all(title, '[^\s]+')) AS title_words
  FROM page_full
), scored AS (
  SELECT *, CASE WHEN blocked THEN 'skip'
      ELSE coalesce(by_host, by_path, CASE WHEN n >= 300 THEN 'article' ELSE 'other' END) END AS content_type,
    CASE WHEN blocked THEN 0 ELSE least(100,
      CASE WHEN by_host IS NOT NULL THEN 40 ELSE 0 END
      + greatest(CASE WHEN by_path IS NOT NULL THEN 30 ELSE 0 END, CASE WHEN slug THEN 15 ELSE 0 END)
      + CASE WHEN depth BETWEEN 2 AND 5 THEN 5 ELSE 0 END
      + CASE WHEN n >= 100 THEN 10 ELSE 0 END + CASE WHEN n >= 200 THEN 15 ELSE 0 END
      + CASE WHEN n >= 500 THEN 10 ELSE 0 END + CASE WHEN n >= 1000 THEN 5 ELSE 0 END
      + CASE WHEN ratio >= 0.3 THEN 10 ELSE 0 END + CASE WHEN ratio >= 0.5 THEN 5 ELSE 0 END
      + CASE WHEN title_words >= 3 THEN 5 ELSE 0 END) END::BIGINT AS quality_points
  FROM matched
)
"""
QUALITY_SCORE = f"""
WITH {QUALITY_CTE} SELECT page_id, content_type, quality_points, quality_points / 100.0::DOUBLE AS quality_score FROM scored
"""


def content_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.with_quality(base.pages(spark, sf_dir)).groupBy("content_type").agg(F.count("*").alias("pages"))


CONTENT_TYPES = f"WITH {QUALITY_CTE} SELECT content_type, count(*)::BIGINT AS pages FROM scored GROUP BY 1"


def sensitive_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scale.spread(base.documents(spark, sf_dir), "chunk_id")
    counts = [c.alias(n) for n, c in admission.sensitive_counts(F.col("text")).items()]
    return docs.select("chunk_id", *counts, admission.sensitive_reason(F.col("text")).alias("reason"))


W = r"[\p{L}\p{N}_]"
# Word boundaries are spelled out: a match must not touch another word character.
LUHN_SQL = r"""
(list_sum(list_transform(range(1, length(d) + 1), lambda i:    CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT
        WHEN substr(d, i, 1)::INT * 2 > 9 THEN substr(d, i, 1)::INT * 2 - 9
        ELSE substr(d, i, 1)::INT * 2 END)) % 10 = 0)
"""


def _sensitive_cte(source: str = "(SELECT doc_id, text, 0 AS given FROM documents)") -> str:
    """`judged`: hits and reason per row of a source with `doc_id, text, given` word count."""
    return rf"""
hits AS (
  SELECT doc_id, text, coalesce(nullif(given, 0), len(regexp_extract_all(text, '[^\s]+')))::BIGINT AS n,
    list_distinct(list_filter(list_transform(
        regexp_extract_all(text, '\b\d[\d -]{{11,24}}\d\b'), lambda m: replace(replace(m, ' ', ''), '-', '')),
      lambda d: length(d) BETWEEN 13 AND 19 AND {LUHN_SQL})) AS c,
    list_distinct(regexp_extract_all(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')) AS s,
    list_distinct(regexp_extract_all(text, '\b[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}\b')) AS b,
    list_distinct(regexp_extract_all(text, '\b[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+\.[\p{{L}}\p{{N}}_.-]+\b')) AS e,
    {' + '.join(f"contains(lower(text), {quote(p)})::INT" for p in rules.AUTH_PHRASES)} AS phrases
  FROM {source}
), judged AS (
  SELECT *, len(c)::BIGINT AS cards, len(s)::BIGINT AS ssns, len(b)::BIGINT AS ibans, len(e)::BIGINT AS emails,
    CASE WHEN length(text) = 0 THEN NULL
      WHEN len(c) >= 3 OR (n < 400 AND len(c) >= 1) THEN 'pii:card'
      WHEN len(s) >= 3 OR (n < 400 AND len(s) >= 1) THEN 'pii:ssn'
      WHEN len(b) >= 3 OR (n < 400 AND len(b) >= 1) THEN 'pii:iban'
      WHEN len(e) >= 5 AND len(e) / greatest(n, 1) > 0.02 THEN 'pii:contact-density'
      WHEN n < 150 AND phrases >= 2 THEN 'auth-text' END AS reason
  FROM hits
)
"""


SENSITIVE_CTE = _sensitive_cte()
SENSITIVE = f"WITH {SENSITIVE_CTE} SELECT doc_id AS chunk_id, cards, ssns, ibans, emails, reason FROM judged"


def contact_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scale.spread(base.documents(spark, sf_dir), "chunk_id")
    emails = admission.sensitive_counts(F.col("text"))["emails"]
    n = F.greatest(T.whitespace_words(F.col("text")), F.lit(1))
    return docs.select("chunk_id", emails.alias("emails"), n.alias("words"), F.round(emails / n, 6).alias("density"))


CONTACT_DENSITY = f"""
WITH {SENSITIVE_CTE} SELECT doc_id AS chunk_id, emails, greatest(n, 1) AS words,
  round(emails / greatest(n, 1), 6) AS density FROM judged
"""


def structural_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural checks on the given pages, and on each page with a form or meta tag put in front."""
    added = F.array(
        F.lit(""),
        F.lit('<form><input type="password" name="p"></form>'),
        F.lit('<input autocomplete="section-x cc-number">'),
        F.lit('<meta content="NOINDEX, nofollow" name="robots">'),
        F.lit('<input type="hidden" name="t"><input name="q">'),
    )
    pages = base.table(spark, sf_dir, "pages").select("page_id", "html", F.posexplode(added).alias("variant", "extra"))
    html = F.concat(F.col("extra"), F.col("html"))
    text = extract.visible_text(html)
    return pages.select(
        "page_id", F.col("variant").cast("long").alias("variant"),
        extract.structural_reason(html, text, T.whitespace_words(text)).alias("reason"),
    )


STRUCTURAL = rf"""
WITH v AS (SELECT * FROM (VALUES (0, ''), (1, '<form><input type="password" name="p"></form>'),
  (2, '<input autocomplete="section-x cc-number">'), (3, '<meta content="NOINDEX, nofollow" name="robots">'),
  (4, '<input type="hidden" name="t"><input name="q">')) AS t(variant, extra)),
t AS (SELECT page_id, variant::BIGINT AS variant,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(extra || html,
    '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'),
    '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM pages, v),
n AS (SELECT *, len(regexp_extract_all(txt, '[^\s]+')) AS n,
  {' + '.join(f"contains(lower(txt), {quote(p)})::INT" for p in rules.AUTH_PHRASES)} AS phrases FROM t)
SELECT page_id, variant, CASE variant WHEN 1 THEN 'password-field' WHEN 2 THEN 'sensitive-autocomplete'
  WHEN 3 THEN 'noindex' ELSE CASE WHEN n > 0 AND n < 150 AND phrases >= 2 THEN 'auth-text' END END AS reason FROM n
"""


def admission_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.gate_reasons(base.page_visits(spark, sf_dir)).select(
        "page_id", "content_type", "quality_points", F.coalesce("skip_reason", F.lit("admitted")).alias("outcome")
    )


FUNNEL_CTE = rf"""
{QUALITY_CTE},
{_sensitive_cte("(SELECT page_id AS doc_id, content AS text, word_count AS given FROM page_full)")},
funnel AS (
  SELECT s.page_id, s.url, s.content_type, s.quality_points,
    CASE WHEN s.content_type = 'skip' THEN 'url_blocked' WHEN s.quality_points < 30 THEN 'low_quality'
      WHEN trim(s.content) = '' THEN 'empty' ELSE j.reason END AS skip_reason
  FROM scored s JOIN judged j ON j.doc_id = s.page_id
)
"""
FUNNEL = f"WITH {FUNNEL_CTE} SELECT page_id, content_type, quality_points, coalesce(skip_reason, 'admitted') AS outcome FROM funnel"


def _document_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skips by site: a document's sensitive reason, else a low word count."""
    docs = scale.spread(base.documents(spark, sf_dir), "chunk_id").join(base.document_times(spark, sf_dir), "chunk_id")
    thin = F.when(T.content_words(F.col("text")) < rules.MIN_PAGE_WORDS, F.lit("low_quality"))
    return docs.select(
        urls.authority(F.col("page_url")).alias("domain"),
        F.coalesce(admission.sensitive_reason(F.col("text")), thin).alias("reason"),
        F.col("last_visited").alias("ts"),
    ).filter(F.col("reason").isNotNull())


def skip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = admission.skip_stats(_document_skips(spark, sf_dir))
    return stats.select("domain", "reason", "count", F.unix_micros("last_seen").alias("last_seen"))


SKIP_CTE = rf"""
{SENSITIVE_CTE}, skips AS (
  SELECT d.source || '.example.com' AS domain, e.ts, coalesce(j.reason,
    CASE WHEN len(list_filter(regexp_extract_all(d.text, '[^\s]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) < 50
         THEN 'low_quality' END) AS reason
  FROM documents d JOIN judged j ON j.doc_id = d.doc_id JOIN events e ON e.event_id = d.doc_id)
"""
SKIP_STATS = f"""
WITH {SKIP_CTE} SELECT domain, reason, count(*)::BIGINT AS count, epoch_us(max(ts)) AS last_seen
FROM skips WHERE reason IS NOT NULL GROUP BY 1, 2
"""


def top_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.top_skipped(admission.skip_stats(_document_skips(spark, sf_dir)))


TOP_SKIPPED = f"""
WITH {SKIP_CTE} SELECT domain, count(*)::BIGINT AS skips, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons
FROM skips WHERE reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
"""


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page HTML with reserved tags planted around it, defused."""
    planted = F.concat(F.lit("< /Context>"), F.col("html"), F.lit("<page_content x><contexts>"))
    return base.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(T.sanitize(planted)).alias("clean_md5"), F.substring(T.sanitize(planted), 1, 40).alias("head")
    )


SANITIZE = r"""
WITH s AS (SELECT page_id, regexp_replace('< /Context>' || html || '<page_content x><contexts>',
  '(?i)<\s*(/?)\s*(context|entity_relationships|page_content|browsing_activity)\b', '[\1\2', 'g') AS t FROM pages)
SELECT page_id, md5(t) AS clean_md5, left(t, 40) AS head FROM s
"""


def date_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside each date preset before the reference time, with validated ISO bounds."""
    ts = F.col("ts")
    flags = {
        name: F.count_if(times.between_dates(ts, times.preset_start(name, base.as_of()), base.as_of()))
        for name in ("all", "today", "week", "month", "quarter")
    }
    bound = times.iso_instant(F.lit("2024-01-15T00:00:00Z"))
    bad = times.iso_instant(F.lit("last tuesday"))
    return base.events(spark, sf_dir).groupBy("event_type").agg(
        *[c.alias(f"in_{n}") for n, c in flags.items()],
        F.count_if(times.between_dates(ts, bound, F.lit(None).cast("timestamp"))).alias("since_iso"),
        F.count_if(times.between_dates(ts, bad, F.lit(None).cast("timestamp"))).alias("bad_bound_is_open"),
    )


DATE_PRESETS = """
SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-31') AS in_all,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-30' AND TIMESTAMP '2024-01-31') AS in_today,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31') AS in_week,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31') AS in_month,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2023-11-02' AND TIMESTAMP '2024-01-31') AS in_quarter,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS since_iso, count(*) AS bad_bound_is_open
FROM events GROUP BY 1
"""

QUERIES = {
    "url_parts": (url_parts, URL_PARTS),
    "base_url_dedup": (base_url_dedup, BASE_URL_DEDUP),
    "reference_list": (reference_list, REFERENCE_LIST),
    "exact_references": (exact_references, EXACT_REFERENCES),
    "visit_records": (visit_records, VISIT_RECORDS),
    "visit_rejects": (visit_rejects, VISIT_REJECTS),
    "page_text": (page_text, PAGE_TEXT),
    "page_metadata": (page_metadata, PAGE_METADATA),
    "text_density": (text_density, TEXT_DENSITY),
    "url_rules": (url_rules, URL_RULES),
    "user_blocklist": (user_blocklist, USER_BLOCKLIST),
    "quality_score": (quality_score, QUALITY_SCORE),
    "content_type_distribution": (content_type_distribution, CONTENT_TYPES),
    "sensitive_content": (sensitive_content, SENSITIVE),
    "contact_density": (contact_density, CONTACT_DENSITY),
    "structural_sensitivity": (structural_sensitivity, STRUCTURAL),
    "admission_funnel": (admission_funnel, FUNNEL),
    "skip_stats": (skip_stats, SKIP_STATS),
    "top_skipped": (top_skipped, TOP_SKIPPED),
    "sanitize": (sanitize, SANITIZE),
    "date_presets": (date_presets, DATE_PRESETS),
}
