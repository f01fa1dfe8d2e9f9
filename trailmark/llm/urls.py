"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs; in the registered query those are the URLs that a rule decides.
Everything is column expressions; the trees are applied as CASE expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import boost, common
from trailmark.operators import scale

#: Rows the trees are fitted on at most.
TRAINING_ROWS = 50_000
#: The rules become one CASE expression, so their number is bounded.
MAX_RULES = 500
FEATURES = (
    "url_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "hyphens", "entropy", "parameters",
    "suffix_rate", "suffix_rows",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, then path from the first slash on

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one wraps the others
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of the text's own character frequencies; 0 for an empty text."""
    n = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    )
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))) \
        .otherwise(0.0)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features of `url, host, path`, and the host's `suffix` (its last two labels)."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_chars": n,
        "host_chars": F.length("host").cast("double"),
        "path_chars": F.length("path").cast("double"),
        "labels": _count(F.col("host"), ".") + 1,
        "depth": _count(F.col("path"), "/"),
        "digit_ratio": F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0),
        "hyphens": _count(F.col("host"), "-"),
        "entropy": entropy(url),
        "parameters": _count(query, "="),
        "suffix": F.substring_index("host", ".", -2),
    })


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """`suffix, suffix_rate, suffix_rows`: the smoothed share of label 1 and the number of labelled
    URLs (as a logarithm) of each host suffix."""
    return labelled.groupBy("suffix").agg(
        ((F.sum("label") + 0.5) / (F.count("*") + 1)).alias("suffix_rate"),
        F.log1p(F.count("*").cast("double")).alias("suffix_rows"),
    )


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None,
           training_rows: int = TRAINING_ROWS) -> DataFrame:
    """`id, host, path, rule, verdict, score` of every row of `pages` (`id, url`).

    The longest fitting rule gives the verdict; otherwise the trees do: block from a `score`
    (probability of block) of 0.5. They learn from `labelled` (`url, label`, 1 is block), or from
    the URLs of `pages` that a rule decides. Without labelled URLs of both kinds the score is that
    of the only kind, 0 if there is none. A null url, or one without `://`, has an empty host and path.
    """
    def parsed(rows):
        rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
        return with_features(rows.withColumn("rule", rule).withColumn("by_rule", verdict))

    rows = parsed(pages)
    if labelled is None:
        known = rows.filter(F.col("by_rule").isNotNull()).withColumn("label", (F.col("by_rule") == "block").cast("int"))
    else:
        known = parsed(labelled.select("url", "label")).filter(F.col("label").isNotNull())
    statistics = common.cut(suffix_statistics(known))
    fill = {"suffix_rate": 0.5, "suffix_rows": 0.0}

    def joined(x):
        return scale.lookup_join(x, statistics, "suffix", "left", spread_by=F.col("url")).fillna(fill)

    model = boost.fit(joined(known), FEATURES, "label", training_rows)
    score = model.probability({name: F.col(name) for name in FEATURES})
    return joined(rows).withColumn("score", score).select(
        "id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score",
    )


def op1_urls(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages")
    return judged(pages.select(F.col("page_id").alias("id"), "url")).withColumnRenamed("id", "page_id")
