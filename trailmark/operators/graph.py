"""The entity graph: edges, neighbours, components, context and the node/link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import urls as U
from trailmark.operators import scale
from trailmark.operators.entities import page_pairs
from trailmark.session import cut_lineage, materialize

CO_OCCURS = "co_occurs_with"
# Names that the first, heaviest level of `page_neighbours` has at least, and the factor from one level to the next.
LEVEL_NAMES = 100
LEVEL_STEP = 4


def both_ways(edges: DataFrame) -> DataFrame:
    """`src, dst, weight` in both directions of the canonical `a, b, weight` edges."""
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )
    return edges.select("weight", F.explode(ends).alias("e")).select("e.src", "e.dst", "weight")


def add_relations(edges: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds explicit `source, target, weight` rows to the edge table.

    Self-loops, blanks and unknown entities are ignored; weights of equal pairs add up.
    """
    cleaned = relations.select(
        F.lower(F.trim("source")).alias("s"), F.lower(F.trim("target")).alias("t"), "weight"
    ).filter((F.col("s") != "") & (F.col("t") != "") & (F.col("s") != F.col("t")))
    known = entities.select("key")
    valid = cleaned.join(known.withColumnRenamed("key", "s"), "s", "left_semi").join(
        known.withColumnRenamed("key", "t"), "t", "left_semi"
    )
    new = valid.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), F.col("weight").cast("double"))
    return edges.select("a", "b", "weight").unionByName(new).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def neighbours(seeds: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, k: int = 20) -> DataFrame:
    """`seed, name, entity_type, frequency, distance, weight, rank` for a table of `seed` keys.

    Breadth first: a node counts at the distance where it is first reached, with the heaviest edge
    that reaches it there. Strongest first, then nearest; `k` per seed. Each hop is written out, as
    the next one reads it several times. Spark would take a written table for as small as its files
    and broadcast it, which the driver's memory does not hold; joins with one are merge joins.
    """
    links = both_ways(edges)
    visited = materialize(seeds.select("seed", F.col("seed").alias("node")).distinct())
    frontier = visited
    reached: DataFrame | None = None
    for hop in range(1, hops + 1):
        entry = frontier.withColumnRenamed("node", "src")
        usable = links
        if reached is not None and hop == hops:
            # The last hop only matters where it beats the k-th neighbour a seed already has: a node
            # further away loses a tie.
            kth = scale.top_rows(reached, ["seed"], [F.desc("weight")], k).filter(F.col("rank") == k)
            entry = entry.join(kth.select("seed", F.col("weight").alias("bound")), "seed", "left")
            entry = materialize(entry.withColumn("bound", F.coalesce("bound", F.lit(0.0))))
            usable = links.filter(F.col("weight") > entry.agg(F.min("bound")).scalar())
        else:
            entry = entry.withColumn("bound", F.lit(0.0))
        step = (
            scale.lookup_join(usable, entry, "src", spread_by=F.col("dst"))
            .filter(F.col("weight") > F.col("bound"))
            .select("seed", F.col("dst").alias("node"), "weight")
        )
        found = materialize(
            step.groupBy("seed", "node").agg(F.max("weight").alias("weight"))
            .join(visited.hint("merge"), ["seed", "node"], "left_anti")
            .withColumn("distance", F.lit(hop).cast("long"))
        )
        frontier = found.select("seed", "node")
        visited = visited.unionByName(frontier)
        reached = found if reached is None else reached.unionByName(found)
    best = scale.top_rows(
        reached, ["seed"], [F.desc("weight"), F.asc("distance"), F.asc("node")], k
    ).withColumnRenamed("node", "key")
    return best.join(entities.select("key", "name", "entity_type", "frequency").hint("merge"), "key").select(
        "seed", "name", F.col("key").alias("node"), "entity_type", "frequency", "distance", "weight", "rank"
    )


def _first_level(entities: DataFrame) -> int:
    """The largest power of LEVEL_STEP that LEVEL_NAMES entities reach with their frequency, or 1. One row per power is read."""
    power = F.floor(F.log(float(LEVEL_STEP), "frequency") + 1e-9).cast("int")
    names = dict(entities.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect())
    powers = [p for p in names if p is not None and sum(n for q, n in names.items() if q is not None and q >= p) >= LEVEL_NAMES]
    return LEVEL_STEP ** max(powers, default=0)


def _links_of(page_rows: DataFrame, entities: DataFrame, ends: DataFrame, least: int) -> DataFrame:
    """`src, dst, weight`: the edges of `least` pages or more with an end among `ends` (`key`), in both directions.

    Both ends of such an edge are on as many pages, so that rarer names make no pairs, nor does a page without one of
    `ends`. These sort after the others: a pair without any has none as its second name.
    """
    rows = page_rows.select("page_url", "key")
    showing = scale.lookup_join(rows, ends, "key", "left_semi", spread_by=F.col("page_url")).select("page_url").distinct()
    rows = scale.lookup_join(rows, materialize(showing), "page_url", "left_semi")
    if least > 1:
        heavy = entities.filter(F.col("frequency") >= least).select("key")
        rows = scale.lookup_join(rows, heavy, "key", "left_semi", spread_by=F.col("page_url"))
    marked = scale.lookup_join(rows, ends.withColumn("end", F.lit("1")), "key", "left", spread_by=F.col("page_url"))
    pairs = page_pairs(marked.select("page_url", F.concat(F.coalesce("end", F.lit("0")), "key").alias("key")))
    met = pairs.filter(F.col("b").startswith("1")).groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))
    own = met.filter(F.col("weight") >= least).select(F.expr("substring(a, 2)").alias("a"), F.expr("substring(b, 2)").alias("b"), "weight")
    return both_ways(own)


def page_neighbours(seeds: DataFrame, page_rows: DataFrame, entities: DataFrame, k: int = 20) -> DataFrame:
    """What `neighbours` finds within two hops, from the names of the pages (`page_url, key`) and their `frequencies`
    alone: the edges are not made.

    Level by level, from heavy to light: the edges of at least so many pages, all of which lie between names of that
    frequency, decide every neighbour of that weight. A seed that has `k` of them is settled, as all others weigh less;
    the rest goes on to the next level, at last to all edges of its first hop. Exact, whatever the levels.
    """
    left = materialize(seeds.select("seed").distinct())
    shown = scale.lookup_join(
        page_rows.select("page_url", F.col("key").alias("seed")), left, "seed", spread_by=F.col("page_url")
    )
    met = scale.lookup_join(page_rows.select("page_url", F.col("key").alias("node")), materialize(shown), "page_url")
    first = met.filter(F.col("seed") != F.col("node")).groupBy("seed", "node").agg(F.count("*").cast("double").alias("weight"))
    counted = entities.select(F.col("key").alias("node"), "frequency")
    # One row per seed and name on its pages.
    first = materialize(first.join(counted.hint("merge"), "node"))
    least = _first_level(entities)
    order = [F.desc("weight"), F.asc("distance"), F.asc("node")]
    settled: DataFrame | None = None
    while True:
        hop = materialize(scale.lookup_join(first.filter(F.col("frequency") >= least), left, "seed", "left_semi", spread_by=F.col("node")))
        near = hop.filter(F.col("weight") >= least).select("seed", "node", "weight", F.lit(1).cast("long").alias("distance"))
        ends = materialize(hop.select(F.col("node").alias("key")).distinct())
        links = materialize(_links_of(page_rows, entities, ends, least))
        step = scale.lookup_join(links, hop.select("seed", F.col("node").alias("src")), "src", spread_by=F.col("dst"))
        far = (
            step.filter(F.col("dst") != F.col("seed")).groupBy("seed", F.col("dst").alias("node")).agg(F.max("weight").alias("weight"))
            .join(hop.select("seed", "node").hint("merge"), ["seed", "node"], "left_anti")
            .withColumn("distance", F.lit(2).cast("long"))
        )
        best = materialize(scale.top_rows(near.unionByName(far), ["seed"], order, k))
        full = best.filter(F.col("rank") == k).select("seed")
        told = best if least == 1 else best.join(full.hint("merge"), "seed", "left_semi")
        settled = told if settled is None else settled.unionByName(told)
        left = materialize(left.join(full.hint("merge"), "seed", "left_anti"))
        if least == 1 or left.isEmpty():
            break
        least //= LEVEL_STEP
    about = entities.select(F.col("key").alias("node"), "name", "entity_type", "frequency").hint("merge")
    return settled.join(about, "node").select("seed", "name", "node", "entity_type", "frequency", "distance", "weight", "rank")


def entity_context(
    query_entities: DataFrame, edges: DataFrame, entities: DataFrame, hops: int = 2, per_entity: int = 10
) -> DataFrame:
    """`query_id, kg_context`: one block of lines per query that names known entities (`context_lines`).

    Needs `query_id, key, ent_rank`, at most a handful of entities per query.
    """
    seeds = query_entities.select(F.col("key").alias("seed")).distinct()
    return context_lines(query_entities, neighbours(seeds, edges, entities, hops, per_entity), entities)


def page_context(query_entities: DataFrame, page_rows: DataFrame, entities: DataFrame, per_entity: int = 10) -> DataFrame:
    """What `entity_context` tells of two hops, from the names of the pages: no edges are made."""
    seeds = query_entities.select(F.col("key").alias("seed"))
    return context_lines(query_entities, page_neighbours(seeds, page_rows, entities, per_entity), entities)


def context_lines(query_entities: DataFrame, near: DataFrame, entities: DataFrame) -> DataFrame:
    """`query_id, kg_context`: each entity comes first, then its neighbours `near`; a pair already listed for the query
    is left out."""
    known = entities.select("key", F.col("name").alias("shown"), "entity_type").hint("merge")
    heads = query_entities.join(known, "key").select(
        "query_id", "ent_rank", F.lit(0).cast("long").alias("rank"),
        F.concat(F.lit("- "), "shown", F.lit(" ("), "entity_type", F.lit(")")).alias("line"),
    )
    pairs = query_entities.select("query_id", "ent_rank", F.col("key").alias("seed")).join(near, "seed").withColumn(
        "pair", F.struct(F.least("seed", "node"), F.greatest("seed", "node"))
    )
    unseen = scale.first_rows(pairs, ["query_id", "pair"], [F.asc("ent_rank"), F.asc("rank")])
    tails = unseen.select(
        "query_id", "ent_rank", "rank",
        F.concat(
            F.lit(f"  → {CO_OCCURS}: "), "name", F.lit(" ("), "entity_type", F.lit(", weight="),
            F.format_string("%.1f", F.col("weight")), F.lit(")"),
        ).alias("line"),
    )
    lines = heads.unionByName(tails).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("ent_rank", "rank", "line"))).alias("lines")
    )
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.select("query_id", F.concat(F.lit("Knowledge Graph Context:\n"), body).alias("kg_context"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """`key, degree, centrality`, isolated entities included."""
    n = entities.agg(F.count("*").alias("n")).scalar()
    counted = both_ways(edges).groupBy(F.col("src").alias("key")).agg(F.count("*").alias("degree"))
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    return entities.select("key").join(counted, "key", "left").select(
        "key", degree.alias("degree"),
        F.when(n > 1, F.round(degree / (n - 1), 6)).otherwise(F.lit(1.0)).alias("centrality"),
    )


def totals(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: `nodes, edges, density`."""
    n = F.col("nodes").cast("double")
    return (
        entities.agg(F.count("*").alias("nodes"))
        .withColumn("edges", edges.agg(F.count("*").alias("m")).scalar())
        .withColumn(
            "density", F.when(n > 1, F.round(2 * F.col("edges") / (n * (n - 1)), 4)).otherwise(F.lit(0.0))
        )
    )


def components(entities: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """`key, component`: the smallest key of each connected component.

    Every round points each node at its smallest neighbour, follows the pointers twice and
    contracts the edges. At least half of the remaining nodes vanish per round. Each round is
    written to the checkpoint folder.
    """
    labels = entities.select("key", F.col("key").alias("component"))
    work = cut_lineage(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    for _ in range(max_rounds):
        if work.isEmpty():
            return labels
        ends = F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")),
                       F.struct(F.col("b").alias("n"), F.col("a").alias("m")))
        down = (
            work.select(F.explode(ends).alias("e")).select("e.n", "e.m")
            .groupBy("n").agg(F.min("m").alias("m"))
            .select("n", F.least("n", "m").alias("root"))
        )
        down = cut_lineage(down)
        for _ in range(2):
            hop = down.select(F.col("n").alias("root"), F.col("root").alias("next"))
            down = scale.lookup_join(down, hop, "root", spread_by=F.col("n")).select("n", F.col("next").alias("root"))
        down = cut_lineage(down)

        def follow(rows: DataFrame, column: str, other: str) -> DataFrame:
            pointer = down.select(F.col("n").alias(column), "root")
            joined = scale.lookup_join(rows, pointer, column, "left", spread_by=F.col(other))
            return joined.withColumn(column, F.coalesce("root", column)).drop("root")

        labels = cut_lineage(follow(labels, "component", "key"))
        work = cut_lineage(
            follow(follow(work, "a", "b"), "b", "a")
            .filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def isolated(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without an edge."""
    linked = both_ways(edges).select(F.col("src").alias("key")).distinct()
    return entities.join(linked, "key", "left_anti")


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def export_parts(
    pages: DataFrame, entities: DataFrame, edges: DataFrame,
    max_pages: int | None = None, max_entities: int | None = None, max_edges: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Node and link tables of the graph export: pages with their sites, entities, edges between them.

    A view for the eye takes the newest pages and the top entities and edges by the three limits; all
    rows without. Edges are those of the same pages, so that all their ends are among all entities. Groups: 1 people and organisations, 2 other entities, 3 sites, 4 pages.
    """
    def best(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
        return rows if limit is None else rows.orderBy(*order).limit(limit)

    newest = best(pages, max_pages, F.desc("last_visited"), F.asc("url")).withColumn(
        "site", F.coalesce(F.nullif(U.authority(F.col("url")), F.lit("")), F.lit("unknown"))
    )
    top = best(entities, max_entities, F.desc("frequency"), F.asc("key"))
    strong = best(edges, max_edges, F.desc("weight"), F.asc("a"), F.asc("b"))

    sites = newest.select("site").distinct().select(
        F.concat(F.lit("d_"), "site").alias("id"), F.col("site").alias("name"),
        F.lit(3).alias("group"), F.lit(6).cast("long").alias("val"),
    )
    page_nodes = newest.select(
        F.concat(F.lit("p_"), "url").alias("id"),
        F.substring(F.coalesce(F.nullif("title", F.lit("")), F.col("url")), 1, 60).alias("name"),
        F.lit(4).alias("group"),
        _clamp(F.coalesce("visit_count", F.lit(1)), 1, 5).cast("long").alias("val"),
        "url",
    )
    people = F.col("entity_type").isin("person", "organization")
    entity_nodes = top.select(
        F.concat(F.lit("e_"), "key").alias("id"), "name",
        F.when(people, F.lit(1)).otherwise(F.lit(2)).alias("group"),
        F.greatest(F.lit(1), F.col("frequency")).cast("long").alias("val"),
    )
    nodes = sites.unionByName(page_nodes, allowMissingColumns=True).unionByName(entity_nodes, allowMissingColumns=True)

    page_links = newest.select(
        F.concat(F.lit("p_"), "url").alias("source"), F.concat(F.lit("d_"), "site").alias("target"),
        F.lit(1.0).alias("value"),
    )
    inside = strong
    if max_entities is not None:
        keys = top.select("key")
        inside = strong.join(keys.withColumnRenamed("key", "a"), "a", "left_semi").join(
            keys.withColumnRenamed("key", "b"), "b", "left_semi"
        )
    entity_links = inside.select(
        F.concat(F.lit("e_"), "a").alias("source"), F.concat(F.lit("e_"), "b").alias("target"),
        F.col("weight").alias("value"),
    )
    return nodes, page_links.unionByName(entity_links)


def first_links(links: DataFrame, k: int = 6) -> DataFrame:
    """The first `k` links of every node, counted in both directions: `node, other, value, rank`."""
    ends = F.array(
        F.struct(F.col("source").alias("node"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node"), F.col("source").alias("other")),
    )
    sides = links.select("value", F.explode(ends).alias("e")).select("e.node", "e.other", "value")
    return scale.top_rows(sides, ["node"], [F.desc("value"), F.asc("other")], k)
