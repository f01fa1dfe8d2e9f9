"""Personal data by candidate gradient boosting, in column expressions alone.

Base patterns with checks (email, ip, card, phone) always count. Generators of high recall propose
further spans, which may overlap: address-like, number-like and key-like strings. Boosted trees score a
candidate by its format and context; they learn from candidates that a base check, a telling cue
or, for numbers, telling counter-evidence (dates, counts, failed checks) decides. A threshold per generator is calibrated on the scores of those, and what reaches it is
added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import boost, common

#: Distinct vectors of candidates the trees are fitted on at most, about.
TRAINING_ROWS = 50_000
#: Share of right candidates that an accepted score must promise, and steps of the score scale.
PRECISION, STEPS = 0.95, 50

# An email's local part starts where a run starts or the last match ended, so no run is read twice.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "address": _LOCAL + r" ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])(?:\+|\((?=[0-9]{1,5}\)))?[0-9](?:[ ().-]{0,3}[0-9])++",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_CUES = {
    "address": r"(?i)\b(?:e-?mail|mail|contact|write)",
    "number": r"(?i)\b(?:tel(?:e(?:phone|fax|fon))?|phone|call|fax|mobil[a-z]*|card|visa|iban|ssn|ip)\b",
    "key": r"(?i)(?:\b|_)(?:api)?(?:token|key|secret|password|credentials?)\b",
}
# Not a number of a person, whatever stands before: dates and years, digits that no card has.
_NO_NUMBER = r"^(?:(?:1[0-9]|20)[0-9]{2}([.-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([.-])[01]?[0-9]\2(?:1[0-9]|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2}-(?:1[0-9]|20)[0-9]{2})$"
# Counts, decimals and versions, unless a cue stands before.
_PLAIN_NUMBER = r"^(?:[0-9]+|[0-9]+(?:\.[0-9]+)+|[0-9]{1,3}(?: [0-9]{3})+)$"
_KNOWN_KEY = r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|glpat-|AIza)"
SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"
FEATURES = ("chars", "digits", "uppers", "lowers", "distinct", "breaks", "joined", "cue", "address", "number")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string has a right Luhn check digit."""
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, hint: Column) -> tuple[Column, Column]:
    """All matches of `pattern` and the stretches around them (one more than matches). Texts without the
    `hint` are not searched."""
    none = F.array().cast("array<string>")
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none), \
        F.when(hint, F.split(text, pattern, -1)).otherwise(none)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column) -> Column:
    """The items in about as many blocks as a block has items: a fold that adds to a list copies the list, so
    a list is folded block by block."""
    def cut(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        numbers = F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1)
        return F.when(F.size(x) > 0, F.transform(numbers, lambda i: F.slice(x, i * size + 1, size))).otherwise(F.slice(F.array(x), F.lit(1), F.lit(0)))

    return let(items, cut)


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each number what `combine` makes, from 0 on, of those before it, and of all of them at the end."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit(0).cast("long")).alias("all"))

    def step(a: Column, x: Column) -> Column:
        after = combine(a["at"], x)
        return F.struct(after.alias("at"), F.concat(a["all"], F.array(after)).alias("all"))

    return F.aggregate(values, start, step, lambda a: a["all"])


def located(found: Column, around: Column) -> Column:
    """`text, start, end, before, after` of each match: code points, end exclusive, and its context.

    Every array is an argument of a pass over the matches, so nothing is evaluated per match; the passes go
    block by block.
    """
    span = "array<struct<text: string, start: bigint, end: bigint, before: string, after: string>>"
    zipped = F.zip_with(F.slice(around, F.lit(1), F.size(found)), found, lambda a, m: F.struct(a.alias("gap"), m.alias("text")))
    zipped = F.zip_with(zipped, F.slice(around, F.lit(2), F.greatest(F.size(around), F.lit(1))),
                        lambda x, n: F.struct(x["gap"], x["text"], n.alias("next")))

    def length(x: Column) -> Column:
        return (F.length(x["gap"]) + F.length(x["text"])).cast("long")

    def step(a: Column, x: Column) -> Column:
        first = a["at"] + F.length(x["gap"])
        last = a["at"] + length(x)
        one = F.struct(
            x["text"].alias("text"), first.alias("start"), last.alias("end"),
            F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(8)).alias("after"),
        )
        return F.struct(last.alias("at"), F.concat(a["spans"], F.array(one)).alias("spans"))

    def block(items: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast(span).alias("spans"))
        return F.aggregate(items, start, step, lambda a: a["spans"])

    def all_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + length(x)))
        begins = F.slice(before_each(sizes, lambda a, x: a + x), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, begins, block))

    return F.when(F.size(found) > 0, let(in_blocks(zipped), all_blocks)).otherwise(F.array().cast(span))


def _features(kind: str, x: Column) -> Column:
    text = x["text"]

    def size(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("double")

    n = F.length(text).cast("double")
    cue = x["before"].rlike(_CUES[kind])
    joined = x["before"].rlike(r"[\p{L}\p{N}]$") | x["after"].rlike(r"^[\p{L}\p{N}]")
    if kind == "address":
        label = F.when(text.rlike("^" + BASE["email"] + "$"), 1)
        base = text.rlike("^" + BASE["email"] + "$")
    elif kind == "number":
        base = F.lit(False)
        for name in ("ip", "card", "phone"):
            base = base | (text.rlike("^(?:" + BASE[name] + ")$") & passes(name, text))
        n_digits = F.length(_digits(text))
        quad = text.rlike("^(?:" + BASE["ip"] + ")$")
        against = text.rlike(_NO_NUMBER) | (n_digits >= 16) | quad | joined | (~cue & text.rlike(_PLAIN_NUMBER))
        label = F.when(base, 1).when(against, 0).when(cue, 1)
    else:
        base = F.lit(False)
        known = text.rlike(_KNOWN_KEY) | cue
        label = F.when(known, 1).otherwise(0)
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        n.alias("chars"), size("[^0-9]").alias("digits"), size("[^A-Z]").alias("uppers"), size("[^a-z]").alias("lowers"),
        (F.size(F.array_distinct(F.split(text, ""))) / n).alias("distinct"),
        (F.size(F.split(text, "[^A-Za-z0-9]+")) - 1).cast("double").alias("breaks"),
        (x["before"].rlike(r"[\p{L}\p{N}]$").cast("double") + x["after"].rlike(r"^[\p{L}\p{N}]").cast("double")).alias("joined"),
        cue.cast("double").alias("cue"),
        F.lit(float(kind == "address")).alias("address"), F.lit(float(kind == "number")).alias("number"),
        base.alias("base"), label.cast("int").alias("label"),
    )


def proposed(docs: DataFrame) -> DataFrame:
    """Adds to `row, text` `_base`, the spans that base patterns and checks find, and `_candidates`, the
    generators' spans with their features. Written to the shared folder without `text`: the texts are
    searched once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    at = F.contains(text, F.lit("@"))
    hints = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+"))}
    wider = {
        "address": at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")), "number": digit,
        "key": digit,
    }
    columns = {}
    for kind, pattern in {**BASE, **GENERATORS}.items():
        columns[f"_m_{kind}"], columns[f"_a_{kind}"] = matches(text, pattern, {**hints, **wider}[kind])
    rows = docs.select("row", *[c.alias(n) for n, c in columns.items()])
    rows = rows.select("row", *[located(F.col(f"_m_{k}"), F.col(f"_a_{k}")).alias(f"_l_{k}") for k in {**BASE, **GENERATORS}])
    def checked(kind: str) -> Column:
        return F.transform(F.filter(f"_l_{kind}", lambda x: passes(kind, x["text"])), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def candidates(kind: str) -> Column:
        enough = {
            "address": lambda x: F.lit(True), "number": lambda x: F.length(_digits(x["text"])) >= 7,
            "key": lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"),
        }
        return F.transform(F.filter(f"_l_{kind}", enough[kind]), lambda x: _features(kind, x))

    base, wide = [checked(k) for k in BASE], [candidates(k) for k in GENERATORS]
    return common.cut(rows.select("row", F.concat(*base).cast(SPAN).alias("_base"), F.concat(*wide).alias("_candidates")))


def fit(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> tuple[boost.Model, dict[str, float]]:
    """The trees and, per generator, the least score from which on at least PRECISION of the decided
    candidates are right; a generator without such a score adds nothing."""
    decided = rows.select(F.explode("_candidates").alias("c")).select("c.*").filter(F.col("label").isNotNull())
    model = boost.fit(decided, FEATURES, "label", training_rows, strata=("address", "number"))
    score = model.probability({f: F.col(f) for f in FEATURES})
    steps = decided.groupBy("kind", F.floor(score * STEPS).cast("int").alias("step")).agg(
        F.count("*").alias("n"), F.sum("label").alias("right")
    ).collect()  # at most STEPS + 1 rows per generator
    thresholds = {}
    for kind in GENERATORS:
        n = right = 0
        for row in sorted((r for r in steps if r["kind"] == kind), key=lambda r: -r["step"]):
            n, right = n + row["n"], right + row["right"]
            if right >= PRECISION * n:
                thresholds[kind] = row["step"] / STEPS
    return model, thresholds


def detected(docs: DataFrame, text_col: str = "text", training_rows: int = TRAINING_ROWS) -> DataFrame:
    """All columns of `docs`, `base` and `spans`: arrays of `kind, start, end` (code points, end
    exclusive), ordered by kind (email, ip, card, phone, address, number, key), then start.

    `spans` holds `base` and the accepted candidates that are no base match themselves; they may
    overlap. A null or empty text has none. Without decided candidates of both labels the trees are
    a constant.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    rows = proposed(docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text")))
    model, thresholds = fit(rows, training_rows)

    def accepted(x: Column) -> Column:
        score = model.probability({f: x[f] for f in FEATURES})
        least = F.lit(2.0)
        for kind, value in thresholds.items():
            least = F.when(x["kind"] == kind, F.lit(value)).otherwise(least)
        return ~x["base"] & (score >= least)

    added = F.transform(F.filter("_candidates", accepted), lambda x: F.struct(x["kind"], x["start"], x["end"])).cast(SPAN)
    return rows.select("row.*", F.col("_base").alias("base"), F.concat("_base", added).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """`text` with every stretch that spans cover replaced by the first span's kind in brackets.

    A block of spans is cut out of the stretch of text that belongs to it, so the whole text is only walked
    once per block.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def block(items: Column, begin: Column, stretch: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(a: Column, s: Column) -> Column:
            gap = F.substring(stretch, (a["at"] - begin + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
            fresh = F.concat(a["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
            return F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when((s["start"] >= a["at"]) & (s["end"] > a["at"]), fresh).otherwise(a["parts"]).alias("parts"),
            )

        return F.aggregate(items, start, step, lambda a: F.array_join(a["parts"], ""))

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    def all_blocks(blocks: Column) -> Column:
        ends = before_each(F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"]))), F.greatest)

        def joined(at: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.size(blocks) - 1)
            parts = F.transform(numbers, lambda i: let(
                cut(F.get(at, i), F.get(at, i + 1)), lambda stretch: block(F.get(blocks, i), F.get(at, i), stretch)
            ))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(at, -1), F.length(text).cast("long")))

        return let(ends, joined)

    return F.when(F.size(spans) > 0, let(in_blocks(ordered), all_blocks)).otherwise(text)


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir):
    found = detected(common.table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )


def redacted(spark, docs, sf_dir):
    """Pipeline stage: all documents, personal data replaced in their texts; `n_chars` follows the text.

    A null or empty text stays as it is. Repeated rows and null ids are rows like any other; all columns are
    kept, whatever their names.
    """
    found = detected(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    touched = F.size("spans") > 0
    new = F.when(touched, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.select("row", new.alias("text"), touched.alias("touched"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("touched"), length).otherwise(F.col("row.n_chars"))
    return found.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])
