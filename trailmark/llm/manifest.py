"""Merkle manifest of a dataset, with proofs by octopus multiproof.

Every row is a leaf. The leaves of a language, in ascending order of id, are the ground of an 8-ary tree;
the languages' roots are the ground of the top tree. A leaf partition is an aligned block of consecutive
leaves. It works out once which nodes its leaves' proofs need that it cannot derive from the leaves
themselves (the minimal union of missing coordinates), fetches those, derives all shared interiors, and
expands every leaf's own proof from them, so no proof is ever shipped.

Digests are lower-case hex SHA-256, and a node is the digest of its children's digests as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

ARITY = 8
#: Leaves of a leaf partition, a power of ARITY. Bounds the memory of a task.
BLOCK = ARITY**4
#: Name of the top tree; the trees of languages are called "" or "=" and the language.
TOP = "top"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """Digest of the columns, each `-` if null, else its length in bytes, a colon and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tree_name(lang: Column) -> Column:
    """Sorts like the language, null first, bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def tampered(id_col: str = "doc_id") -> Column:
    """The rows that the check alters: where 3 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
           fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`row, id, tree, leaf, altered`: the leaf of every row, and the leaf it has after the tampering where
    it is tampered with. `row` tells equal rows apart. Written to the shared folder."""
    plain = [F.col(c) for c in fields]
    lowered = [common.ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in fields]
    return common.cut(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), tree_name(F.col(lang_col)).alias("tree"),
        row_digest(plain).alias("leaf"), F.when(tampered(id_col), row_digest(lowered)).alias("altered"),
    ))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `idx`, the place of a row in its group by `order` from 0, and `n`, the size of the group.

    Rows are dealt by ranges of (group, order), so that a group of any size is many tasks; a task's place in
    its group follows from the counts of the tasks before it, one row per task and group.
    """
    # The place of a row in its task is the lower 33 bits. It is written, so it never changes once read.
    sorted_rows = common.cut(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    runs = sorted_rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.cut(runs.select(
        group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("n"),
    ))
    placed = scale.lookup_join(sorted_rows, offsets, [group, "_part"], spread_by=F.col("_at"))
    return placed.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def climb(ground: DataFrame) -> list[DataFrame]:
    """All levels above `ground` (`tree, n, idx, h`), each written: `tree, n, level, idx, h` with `n` the
    nodes of that tree on that level."""
    levels, level, nodes = [], 0, ground.select("tree", "n", "idx", "h")
    most = ground.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("idx", "h")))
        text = F.array_join(F.transform(children, lambda c: c["h"]), "")
        level, most = level + 1, -(-most // ARITY)
        nodes = common.cut(
            nodes.filter(F.col("n") > 1)
            .groupBy("tree", F.ceil(F.col("n") / ARITY).alias("n"), F.floor(F.col("idx") / ARITY).alias("up"))
            .agg(F.sha2(text, 256).alias("h"))
            .select("tree", "n", F.lit(level).alias("level"), F.col("up").alias("idx"), "h")
        )
        levels.append(nodes)
    return levels


def height(n: int) -> int:
    """Levels from `n` nodes up to the single one."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def missing(known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that the proofs of the leaves `known` (ascending places of `n`) need
    together and that cannot be derived from them: the minimal union over all levels."""
    level = 0
    while n > 1:
        up = np.unique(known // ARITY)
        members = (up[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(members[members < n], known, assume_unique=True)
        known, n, level = up, -(-n // ARITY), level + 1


def _coordinates(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What a leaf partition fetches: `tree, block, of, level, idx`. Besides the missing nodes of both trees
    these are the two roots that the manifest states."""
    out: list[list] = [[], [], [], [], []]

    def want(tree, block, of, level, places):
        for column, values in zip(out, ([tree] * len(places), [block] * len(places), [of] * len(places),
                                        [level] * len(places), list(places))):
            column.extend(values)

    for tree, block, first, last, n, at, trees in zip(*(c.to_pylist() for c in batch.columns)):
        for of, known, size in ((tree, np.arange(first, last + 1), n), (TOP, np.array([at]), trees)):
            for level, places in missing(known, size):
                want(tree, block, of, level, places.tolist())
            if of == TOP or size > 1:  # a lone leaf is its tree's root
                want(tree, block, of, height(size), [0])
    return pa.record_batch(
        [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
         pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())],
        names=["tree", "block", "of", "level", "idx"],
    )


def derive(ground: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, tuple[str, str]]], str]:
    """From the hashes of some leaves of a tree and the fetched nodes: for every level, the sibling digests left
    and right of each node on the way up, and the root."""
    levels, nodes, level = [], ground, 0
    while n > 1:
        beside, above = {}, {}
        for up in {i // ARITY for i in nodes}:
            run = range(up * ARITY, min(n, (up + 1) * ARITY))
            hashes = [nodes[i] if i in nodes else fetched[level, i] for i in run]
            for k, i in enumerate(run):
                if i in nodes:
                    beside[i] = "".join(hashes[:k]), "".join(hashes[k + 1 :])
            above[up] = digest("".join(hashes))
        levels.append(beside)
        nodes, n, level = above, -(-n // ARITY), level + 1
    return levels, nodes[0]


def expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """A leaf partition's rows with their proofs. Shared interiors are derived once; a leaf adds its own
    siblings. Rows that are tampered with are folded up on their own; for the others the derived root is
    that fold."""
    tree = rows.column("tree")[0].as_py()
    n, at, trees = (rows.column(c)[0].as_py() for c in ("n", "at", "trees"))
    of, level, idx, h = (fetched.column(c).to_pylist() for c in ("of", "level", "idx", "h"))
    own = {(a, b): x for o, a, b, x in zip(of, level, idx, h) if o == tree}
    top = {(a, b): x for o, a, b, x in zip(of, level, idx, h) if o == TOP}
    places, found = rows.column("idx").to_pylist(), rows.column("leaf").to_pylist()
    stated_subroot, stated_root = own.get((height(n), 0), found[0]), top[height(trees), 0]
    lower, subroot = derive(dict(zip(places, found)), n, own)
    upper, derived_root = derive({at: subroot}, trees, top)

    above_top, i = [], at
    for beside in upper:
        above_top.append(beside[i])
        i //= ARITY
    paths: dict[int, tuple[list, str]] = {}

    def above(first: int) -> tuple[list, str]:
        """Sibling pairs, and all of them as text, from level 1 up for the leaves under node `first` there."""
        if first not in paths:
            path, i = [], first
            for beside in lower[1:]:
                path.append(beside[i])
                i //= ARITY
            path += above_top
            paths[first] = path, "".join(a + b for a, b in path)
        return paths[first]

    proofs, folded = [], []
    for place, altered in zip(places, rows.column("altered").to_pylist()):
        path, text = above(place // ARITY)
        left, right = lower[0][place] if lower else ("", "")
        proofs.append(digest(left + right + text))
        node = altered
        if node is not None:
            if lower:
                node = digest(left + node + right)
            for a, b in path:
                node = digest(a + node + b)
        folded.append(derived_root if node is None else node)
    size = len(places)
    return pa.table({
        "id": rows.column("id"), "leaf": rows.column("leaf"),
        "subroot": pa.array([stated_subroot] * size, pa.string()), "root": pa.array([stated_root] * size, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
    })


class Manifest:
    """The written trees of a table: `ground` (`row, id, tree, leaf, altered, idx, n`), `nodes` (`tree, level,
    idx, h` above the ground, and the ground of the top tree), `trees` (`tree, at, trees`: the place of each tree
    below the top, and their number)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text",
                 fields: tuple[str, ...] = FIELDS):
        found = leaves(docs, id_col, lang_col, text_col, fields)
        self.ground = common.cut(numbered(found, "tree", ["id", "leaf", "row"]))
        lower = climb(self.ground.withColumnRenamed("leaf", "h"))
        single = self.ground.filter(F.col("n") == 1).select("tree", F.col("leaf").alias("h"))
        roots = single
        for nodes in lower:
            roots = roots.unionByName(nodes.filter(F.col("n") == 1).select("tree", "h"))
        placed = common.cut(numbered(roots.withColumn("_all", F.lit(TOP)), "_all", ["tree"]))
        top = placed.select(F.lit(TOP).alias("tree"), "n", "idx", "h")
        nodes = [top.withColumn("level", F.lit(0)), *climb(top), *lower]
        self.nodes = nodes[0].select("tree", "level", "idx", "h")
        for level in nodes[1:]:
            self.nodes = self.nodes.unionByName(level.select("tree", "level", "idx", "h"))
        self.trees = placed.select("tree", F.col("idx").alias("at"), F.col("n").alias("trees"))

    def fetch(self, blocks: DataFrame) -> DataFrame:
        """The nodes that leaf partitions (`tree, block, first, last, n, at, trees`) need: `tree, block, of,
        level, idx, h`. A node near the root is asked for by every partition: the join spreads it."""
        wanted = common.cut(blocks.select("tree", "block", "first", "last", "n", "at", "trees").mapInArrow(
            common.per_batch(_coordinates), "tree string, block long, of string, level int, idx long"
        ))
        nodes = self.nodes.withColumnRenamed("tree", "of")
        ask = wanted.filter((F.col("level") > 0) | (F.col("of") == TOP))
        found = scale.lookup_join(ask, nodes, ["of", "level", "idx"], spread_by=F.struct("tree", "block"))
        # Leaves of other partitions: none with aligned blocks, but a wanted subset may need some.
        below = wanted.filter((F.col("level") == 0) & (F.col("of") != TOP))
        ground = self.ground.select(F.col("tree").alias("of"), F.lit(0).alias("level"), "idx", F.col("leaf").alias("h"))
        if not below.isEmpty():
            found = found.unionByName(below.join(ground, ["of", "level", "idx"]).select(*found.columns))
        return found

    def proofs(self, block: int = BLOCK) -> DataFrame:
        """`id, leaf, subroot, root, proof_sha256, folded_root` of every row."""
        rows = scale.lookup_join(self.ground, self.trees, "tree", spread_by=F.col("idx"))
        rows = rows.withColumn("block", F.floor(F.col("idx") / block))
        kind = self.ground.schema["id"].dataType.simpleString()
        blocks = rows.groupBy("tree", "block", "n", "at", "trees").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
        return rows.drop("row").groupBy("tree", "block").cogroup(self.fetch(blocks).groupBy("tree", "block")).applyInArrow(
            expand, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
        )


def verified(docs: DataFrame, **options) -> DataFrame:
    """`id, leaf, subroot, root, proof_sha256, folded_root, verified` per row of `docs`.

    Null values are leaves of their own kind (`-`), and a null language is the first tree. A null id
    comes first and is never tampered with; equal ids are ordered by leaf, and equal rows are interchangeable.
    An empty table gives no rows. Other columns of `docs` are not read.
    """
    found = Manifest(docs, **options).proofs()
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark, sf_dir):
    return verified(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _sql_row(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, source, lang, n_chars, text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS crc
  FROM documents),
leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_row('text')} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_sql_row(f"translate(text, '{common.UPPER}', '{common.LOWER}')")} END AS altered FROM crc),
ground AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY tree) AS n FROM leaf),
low AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h FROM ground
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY ALL),
subroots AS MATERIALIZED (
  SELECT tree, level AS up, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS trees FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, spot AS idx, trees AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY ALL),
node AS MATERIALIZED (
  SELECT tree, level, idx, h FROM low WHERE n > 1
  UNION ALL SELECT s.tree, s.up + g.level, g.idx, g.h FROM high g, subroots s WHERE g.n > 1),
way AS (
  SELECT doc_id, idx AS row, tree, leaf, altered, 0 AS level, CASE WHEN s.up = 0 THEN s.spot ELSE idx END AS spot
  FROM ground JOIN subroots s USING (tree)
  UNION ALL
  SELECT w.doc_id, w.row, w.tree, w.leaf, w.altered, w.level + 1,
    CASE WHEN w.level + 1 = s.up THEN s.spot ELSE w.spot // 8 END
  FROM way w JOIN subroots s USING (tree)
  WHERE w.level + 1 < s.up + (SELECT max(level) FROM high)),
proof AS (
  SELECT w.tree, w.row, sha256(coalesce(string_agg(v.h, '' ORDER BY w.level, v.idx), '')) AS proof_sha256
  FROM way w
  LEFT JOIN node v ON v.tree = w.tree AND v.level = w.level AND v.idx // 8 = w.spot // 8 AND v.idx <> w.spot
  GROUP BY 1, 2),
fold AS (
  SELECT tree, idx AS row, 0 AS level, CASE WHEN s.up = 0 THEN s.spot ELSE idx END AS spot, coalesce(altered, leaf) AS h
  FROM ground JOIN subroots s USING (tree)
  UNION ALL
  SELECT f.tree, f.row, f.level + 1, CASE WHEN f.level + 1 = any_value(s.up) THEN any_value(s.spot) ELSE f.spot // 8 END,
    sha256(string_agg(CASE WHEN v.idx = f.spot THEN f.h ELSE v.h END, '' ORDER BY v.idx))
  FROM fold f JOIN subroots s USING (tree)
  JOIN node v ON v.tree = f.tree AND v.level = f.level AND v.idx // 8 = f.spot // 8 GROUP BY f.tree, f.row, f.level, f.spot),
folded AS (SELECT tree, row, arg_max(h, level) AS folded_root FROM fold GROUP BY 1, 2),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, idx AS row FROM ground) JOIN subroots USING (tree) JOIN proof USING (tree, row) JOIN folded USING (tree, row), top
"""
