"""Quality rules on the level of hosts.

Every document is measured and held against plain rules. Failures are counted per host, and each rule's
failure rates get a beta prior that is estimated from all hosts by moments. A host's rate is shrunk towards
the common rate by that prior, so that few documents cannot condemn a host. A host that fails most of the
time after that is rejected, and its verdict is joined back to its documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

LEAST_WORDS = 50
#: A host is rejected when a rule's shrunk failure rate reaches this.
HOST_LIMIT = 0.5
#: Weight of the prior, in documents, where the hosts hardly differ, and the least it can be.
MOST_WEIGHT, LEAST_WEIGHT = 1e6, 1e-3
#: Rates enter the moments as whole millionths, so that their sums are exact in any order.
UNIT = 1_000_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def rules() -> dict[str, Column]:
    """Rule name to whether a measured document fails it. The first two are the base rules."""
    c = F.col
    return {
        "few_words": c("n_words") < LEAST_WORDS,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
    }


BASE_RULES = ("few_words", "repeats")


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text. `n_lines` are lines with a word."""
    words = text.encode("utf-8", "replace").split()  # bytes are split at 0x20 and 0x09 to 0x0D alone
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return (
        len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, _SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeat_words(words),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`id, host` and the MEASURES of every row. A null text has no words and no lines."""

    def run(batch):
        found = [measure(text) for text in batch.column(2).to_pylist()]
        columns = [pa.array(list(values), pa.int64()) for values in zip(*found)]
        return pa.record_batch([batch.column(0), batch.column(1), *columns], names=["id", "host", *MEASURES])

    rows = docs.select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(
        common.per_batch(run),
        f"id {kinds['id']}, host {kinds['host']}, " + ", ".join(f"{m} long" for m in MEASURES),
    )


def failures(rows: DataFrame) -> DataFrame:
    """`host, n` and the failures of each rule per host. Rows without a host are not counted."""
    return rows.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(fails.cast("long")).alias(name) for name, fails in rules().items()]
    )


def prior(k: int, n: int, failed: int, rates: int, squares: int, shares: int) -> tuple[float, float]:
    """(a, b) of the beta prior of one rule by moments.

    From `k` hosts with `n` documents, of which `failed` fail, and the sums over hosts of the rate, its
    square and 1 / documents, all in UNITs. What the rates vary beyond chance is the spread of the prior.
    """
    if not n:
        return LEAST_WEIGHT, LEAST_WEIGHT
    p = failed / n
    weight = MOST_WEIGHT
    share = shares / k / UNIT
    if k > 1 and 0 < failed < n and share < 1:
        variance = float(k * squares - rates * rates) / (k * (k - 1)) / UNIT / UNIT
        spread = (variance / (p * (1 - p)) - share) / (1 - share)
        if spread > 0:
            weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / spread - 1))
    return p * weight, (1 - p) * weight


def priors(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """The prior of every rule: one row of sums over all hosts comes to the driver."""
    def whole(column: Column) -> Column:
        return F.sum(column.cast("decimal(20,0)"))

    sums = [F.count("*").alias("k"), F.sum("n").alias("n"), whole(F.floor(UNIT / F.col("n"))).alias("shares")]
    for name in rules():
        rate = F.floor(UNIT * F.col(name) / F.col("n"))
        sums += [F.sum(name).alias(f"{name}_f"), whole(rate).alias(f"{name}_r"), whole(rate * rate).alias(f"{name}_s")]
    row = counts.agg(*sums).first()
    return {
        name: prior(*(int(row[c] or 0) for c in ("k", "n", f"{name}_f", f"{name}_r", f"{name}_s", "shares")))
        for name in rules()
    }


def host_verdicts(counts: DataFrame) -> DataFrame:
    """`host, n`, `<rule>_rate` (shrunk) and `host_rejected` per host, from `failures`."""
    known = priors(counts)
    rates = {
        name: (F.col(name) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for name, (a, b) in known.items()
    }
    rejected = F.lit(False)
    for rate in rates.values():
        rejected = rejected | (rate >= HOST_LIMIT)
    return counts.select(
        "host", "n", *[rate.alias(f"{name}_rate") for name, rate in rates.items()], rejected.alias("host_rejected")
    )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """`id, host`, MEASURES, `base_failed, host_rejected, kept` per row of `docs`.

    A document is kept unless it fails a base rule or its host is rejected. A null text counts as empty
    and fails; a document without a host has no host verdict against it. Repeated rows count each. An
    empty table gives no rows. Other columns of `docs` are not read.
    """
    rows = common.cut(measured(docs, id_col, text_col, host_col))
    verdicts = common.cut(host_verdicts(common.cut(failures(rows))))
    rejected = verdicts.filter("host_rejected").select("host", "host_rejected")
    joined = scale.lookup_join(rows, rejected, "host", "left", spread_by=F.struct("id", "n_words", "word_chars"))
    failed = F.lit(False)
    for name in BASE_RULES:
        failed = failed | rules()[name]
    bad_host = F.coalesce(F.col("host_rejected"), F.lit(False))
    return joined.select(
        "id", "host", *MEASURES, failed.alias("base_failed"), bad_host.alias("host_rejected"),
        (~failed & ~bad_host).alias("kept"),
    )


def op11_hosts(spark, sf_dir):
    out = judged(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected", "kept"
    )


_SQL_FAILS = {
    "few_words": f"n_words < {LEAST_WORDS}", "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars", "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}


def _sql_rate(name: str) -> str:
    """The rule's shrunk rate, from its prior: `p` times the weight and the weight."""
    return f"""
{name}_m AS (SELECT count(*) AS k, sum(n) AS n, sum({name}) AS f, sum(({UNIT} * {name}) // n) AS r,
    sum((({UNIT} * {name}) // n) * (({UNIT} * {name}) // n)) AS s, sum({UNIT} // n) AS e FROM host),
{name}_p AS (SELECT *, f::DOUBLE / n AS p, e::DOUBLE / k / {UNIT} AS share,
    (k * s - r * r)::DOUBLE / (k * (k - 1))::DOUBLE / {UNIT} / {UNIT} AS v FROM {name}_m),
{name}_w AS (SELECT p, CASE WHEN k > 1 AND f > 0 AND f < n AND share < 1 AND (v / (p * (1 - p)) - share) / (1 - share) > 0
    THEN least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, 1 / ((v / (p * (1 - p)) - share) / (1 - share)) - 1))
    ELSE {MOST_WEIGHT} END::DOUBLE AS w FROM {name}_p)"""


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT row, i, words[i : i + 2] AS w FROM d, unnest(range(1, len(words) - 1)) AS r(i)),
again AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
rep AS (SELECT row, count(DISTINCT i + j) AS n FROM again, unnest([0, 1, 2]) AS o(j) GROUP BY 1),
m AS MATERIALIZED (
  SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (row)),
host AS MATERIALIZED (
  SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER ({c}) AS {name}" for name, c in _SQL_FAILS.items())}
  FROM m WHERE host IS NOT NULL GROUP BY 1),
{",".join(_sql_rate(name) for name in _SQL_FAILS)},
bad AS (SELECT host FROM host, {", ".join(f"{name}_w" for name in _SQL_FAILS)}
  WHERE {" OR ".join(f"({name} + {name}_w.p * {name}_w.w) / (host.n + ({name}_w.p * {name}_w.w + (1 - {name}_w.p) * {name}_w.w)) >= {HOST_LIMIT}" for name in _SQL_FAILS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM (SELECT *, {_SQL_FAILS['few_words']} OR {_SQL_FAILS['repeats']} AS base_failed,
  coalesce(host IN (SELECT host FROM bad), false) AS host_rejected FROM m)
"""
