"""Entity extraction, frequencies and co-occurrence."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import rules
from trailmark.functions import text as T
from trailmark.operators import lexical, scale
from trailmark.session import materialize

SPAN_TYPE = "array<struct<name:string,label:string>>"
Recognizer = Callable[[Column], Column]
# Names of a page whose pairs are unfolded where the page is.
PAIR_BLOCK = 512
# About how many pairs one task unfolds, and counts before the shuffle, at a time.
PAIRS_PER_TASK = 2_000_000
# About how many pairs are counted in one pass where edges are written; more are written slice by slice.
PAIRS_PER_SLICE = 100_000_000

# Runs of capitalised words, or digit runs. Possessive, so that a run of any length takes no stack.
NAME_PATTERN = r"\p{Lu}[\p{L}\p{N}]*+(?: \p{Lu}[\p{L}\p{N}]*+)*+|\p{N}++"


def capitalised_runs(text: Column) -> Column:
    """Default recogniser: capitalised runs, labelled by shape.

    Stands in for a language model; any expression or pandas UDF that returns name and label spans
    in text order has the same place.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NAME_PATTERN), F.lit(0))

    def label(name: Column) -> Column:
        return (
            F.when(name.rlike(r"^\p{N}+$"), F.lit("CARDINAL"))
            .when(name.contains(" "), F.lit("PERSON"))
            .when(name.rlike(r"^\p{Lu}{2,}$"), F.lit("ORG"))
            .when(name.rlike(r"\p{N}"), F.lit("PRODUCT"))
            .otherwise(F.lit("GPE"))
        )

    return F.transform(found, lambda n: F.struct(n.alias("name"), label(n).alias("label")))


def _entity_type(label: Column) -> Column:
    pairs = [F.lit(x) for item in rules.ENTITY_TYPES.items() for x in item]
    return F.element_at(F.create_map(*pairs), label)


def clean_spans(spans: Column) -> Column:
    """Typed entities in text order: known labels only, 2 to 100 characters, no plain numbers.

    Names are trimmed and lose line breaks and tabs.
    """
    named = F.transform(
        spans,
        lambda s: F.struct(
            F.regexp_replace(F.trim(s["name"]), r"[\n\t]", " ").alias("name"), _entity_type(s["label"]).alias("type")
        ),
    )
    return F.filter(
        named,
        lambda e: e["type"].isNotNull()
        & (e["type"] != "skip")
        & F.length(e["name"]).between(rules.MIN_ENTITY_LENGTH, rules.MAX_ENTITY_LENGTH)
        & ~e["name"].rlike(r"^\p{Nd}+$"),
    )


def extract(chunks: DataFrame, recognizer: Recognizer = capitalised_runs) -> DataFrame:
    """`page_url, chunk_id, chunk_index, pos, key, name, entity_type`: first mention per chunk and name."""
    mentions = chunks.select(
        "page_url", "chunk_id", "chunk_index", F.posexplode(clean_spans(recognizer(F.col("text")))).alias("pos", "e")
    ).select(
        "page_url", "chunk_id", "chunk_index",
        F.lower("e.name").alias("key"),
        F.struct("pos", F.col("e.name").alias("name"), F.col("e.type").alias("type")).alias("m"),
    )
    first = mentions.groupBy("page_url", "chunk_id", "chunk_index", "key").agg(F.min("m").alias("m"))
    return first.select(
        "page_url", "chunk_id", "chunk_index", F.col("m.pos").alias("pos"), "key",
        F.col("m.name").alias("name"), F.col("m.type").alias("entity_type"),
    )


def page_entities(mentions: DataFrame) -> DataFrame:
    """`page_url, key, name, entity_type`: per page, spelling and type of the last chunk win."""
    at = F.struct("chunk_index", "pos")
    return (
        mentions.filter(F.length("key") > 1)
        .groupBy("page_url", "key")
        .agg(
            F.max_by("name", at).alias("name"),
            F.coalesce(F.max_by("entity_type", at), F.lit("concept")).alias("entity_type"),
        )
    )


def frequencies(page_rows: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """`key, name, entity_type, frequency[, first_seen]`: pages that mention each entity.

    The spelling and type come from the greatest page URL, so that the result does not depend on
    row order. `times` gives `page_url, ts`.
    """
    aggregates = [
        F.max_by(F.struct("name", "entity_type"), "page_url").alias("e"), F.count("*").alias("frequency")
    ]
    if times is not None:
        page_rows = page_rows.join(times, "page_url")
        aggregates.append(F.min("ts").alias("first_seen"))
    rows = page_rows.groupBy("key").agg(*aggregates)
    seen = ["first_seen"] if times is not None else []
    return rows.select("key", F.col("e.name").alias("name"), F.col("e.entity_type").alias("entity_type"), "frequency", *seen)


def slices_for(n: int | float) -> int:
    """The power of two of slices that `n` pairs or edges are written in."""
    return 2 ** max(0, math.ceil(math.log2(max(n, 1) / PAIRS_PER_SLICE)))


def edge_slices(*page_rows: DataFrame) -> int:
    """In how many slices the edges of these pages are written."""
    n = F.col("n").cast("double")
    return slices_for(sum(
        rows.groupBy("page_url").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0 for rows in page_rows
    ))


def edge_slice(edges: DataFrame, number: int, slices: int) -> DataFrame:
    """Slice `number` of the edges, by their first name: of pairs only those of the slice are unfolded."""
    return edges if slices == 1 else edges.filter(F.pmod(F.xxhash64("a"), F.lit(slices)) == number)


def _pair_tasks(page_rows: DataFrame, block: int) -> int:
    """Tasks for the pairs of the pages up to `block` names, by PAIRS_PER_TASK; no fewer than there are cores."""
    n = F.col("n").cast("double")
    sizes = page_rows.groupBy("page_url").agg(F.count("*").alias("n")).filter(n <= block)
    pairs = sizes.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    return max(page_rows.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS_PER_TASK))


def page_pairs(page_rows: DataFrame, carry: tuple[str, ...] = (), block: int = PAIR_BLOCK, write_lists: bool = False) -> DataFrame:
    """`page_url, a, b`: unordered pairs of entities on a page, a < b, and the page's columns `carry`.

    The pairs are the edges of the graph. They are unfolded one entity at a time from the sorted name list of a
    page and never held together. The list of a page with more than `block` names is cut into blocks, and
    every pair of blocks is dealt out as work of its own. `write_lists`: the lists are written, for pairs that are
    unfolded more than once.
    """
    keys = ["page_url", *carry]
    lists = page_rows.groupBy(*keys).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    lists = materialize(lists) if write_lists else lists
    small = lists.filter(F.size("keys") <= block).repartition(_pair_tasks(page_rows, block), *keys).select(*keys, F.posexplode("keys").alias("i", "a"), "keys")
    pairs = small.select(*keys, "a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("b"))

    def cut(n: Column) -> Column:
        return F.slice("keys", n * block + 1, F.lit(block))

    large = lists.filter(F.size("keys") > block)
    last = F.ceil(F.size("keys") / block).cast("int") - 1
    heads = large.select(*keys, "keys", F.explode(F.sequence(F.lit(0), last)).alias("hi"), last.alias("last"))
    blocks = heads.select(*keys, "keys", "hi", F.explode(F.sequence("hi", "last")).alias("lo")).select(
        *keys, "hi", "lo", cut(F.col("hi")).alias("left"), cut(F.col("lo")).alias("right")
    ).repartition("page_url", "hi", "lo")
    rest = F.when(F.col("hi") == F.col("lo"), F.slice("right", F.col("i") + 2, F.size("right"))).otherwise(F.col("right"))
    met = blocks.select(*keys, "hi", "lo", "right", F.posexplode("left").alias("i", "a")).select(*keys, "a", F.explode(rest).alias("b"))
    return pairs.unionByName(met)


def page_stars(page_rows: DataFrame) -> DataFrame:
    """`a, b`: the first name of every page with each of its others. Their components are those of `page_pairs`, and
    they are no more than the names."""
    first = page_rows.groupBy("page_url").agg(F.min("key").alias("a"))
    return page_rows.join(first, "page_url").filter(F.col("a") < F.col("key")).select("a", F.col("key").alias("b")).distinct()


def cooccurrence(page_rows: DataFrame) -> DataFrame:
    """`a, b, weight`: number of pages on which both entities occur. Counted before the shuffle."""
    return page_pairs(page_rows).groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def cooccurrence_without(page_rows: DataFrame, evicted: DataFrame) -> DataFrame:
    """The edges of all pages but those of `evicted` (`page_url`), which are left out before pairs are made."""
    gone = evicted.select("page_url").distinct()
    return cooccurrence(scale.lookup_join(page_rows, gone, "page_url", "left_anti", spread_by=F.col("key")))


def edge_delta(old: DataFrame, new: DataFrame, slices: int = 1) -> DataFrame:
    """`a, b, weight`: what edges gain or lose when pages have the entities `new` in place of `old`. Only
    the replaced pages make pairs. `slices`: in how many slices (`edge_slice`) it will be read."""
    gained, lost = (page_pairs(rows, write_lists=slices > 1) for rows in (new, old))
    pairs = gained.select("a", "b", F.lit(1.0).alias("n")).unionByName(lost.select("a", "b", F.lit(-1.0).alias("n")))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight")).filter("weight <> 0")


def apply_delta(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """The edges with `edge_delta` added; an edge that no page shows any more goes."""
    return summed(edges.select("a", "b", "weight").unionByName(delta.select("a", "b", "weight")))


def summed(deltas: DataFrame) -> DataFrame:
    """The edges that all of these deltas make."""
    return deltas.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def relation_sources(page_rows: DataFrame, times: DataFrame) -> DataFrame:
    """`a, b, weight, source_url`: with the first page that showed the pair. Pages without a time are left out
    before pairs are made."""
    return (
        page_pairs(page_rows.join(times, "page_url"), ("ts",))
        .groupBy("a", "b")
        .agg(
            F.count("*").cast("double").alias("weight"),
            F.min(F.struct("ts", "page_url")).alias("s"),
        )
        .select("a", "b", "weight", F.col("s.page_url").alias("source_url"))
    )


def lookup(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities for a table of `name`s, whatever their case."""
    wanted = names.select(F.lower("name").alias("key")).distinct()
    return scale.lookup_join(entities, wanted, "key", "left_semi", spread_by=F.col("key"))


def match_queries(queries: DataFrame, entities: DataFrame, k: int | None = 5) -> DataFrame:
    """`query_id, key, name, ent_rank`: entities named in a query, longest first.

    A name of 3 characters or more must occur between word boundaries. Candidates come from an
    equality join on token runs of the query, then the literal name is checked.
    """
    known = (
        entities.filter(F.length("name") >= 3)
        .select("key", "name", T.terms(F.col("name")).alias("t"))
        .filter(F.size("t") > 0)
        .select("key", "name", F.array_join("t", " ").alias("phrase"), F.size("t").alias("n_tokens"))
    )
    tokens = queries.select("query_id", F.lower("query").alias("lowered"), T.terms(F.col("query")).alias("tokens"))
    lengths = lexical.phrase_lengths(known)
    runs = F.concat(*[T.ngrams(F.col("tokens"), n) for n in lengths])
    candidates = tokens.select("query_id", "lowered", F.explode_outer(F.array_distinct(runs)).alias("phrase"))
    hits = scale.lookup_join(
        known.select("key", "name", "phrase"), candidates, "phrase", spread_by=F.col("key")
    )
    literal = F.concat(F.lit(r"(?U)\b\Q"), F.lower("name"), F.lit(r"\E\b"))
    matched = hits.filter(F.regexp_like(F.col("lowered"), literal)).select("query_id", "key", "name")
    order = [F.desc(F.length("name")), F.asc("key")]
    return scale.top_rows(matched, ["query_id"], order, k if k is not None else 2_147_483_647, "ent_rank")
