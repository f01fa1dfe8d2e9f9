"""Near-duplicate documents by a chosen-path set similarity join.

A document's set of 5-word shingles is represented by the minima of COORDINATES hash functions, its
tokens. In each of TREES independent trees a document follows, from every node it is in, the tokens
that the node's own hash function selects, 1 / SIMILARITY of them on average, so that a pair above
the similarity keeps meeting on some path. Nodes of at most SMALL documents are not branched further;
neither are those at DEPTH. Inside a node documents are compared by all their tokens. What may be
similar is gathered in candidate groups, and links inside them are decided on the full sets.

Documents with equal sets are one class and travel once. Comparisons stop where they could only link
what is linked already: every document outside the largest cluster of its group is compared with all
others, so no link between clusters is missed and a group of near copies costs one round, not all
pairs. Nodes beyond NODE_BLOCK and groups beyond BLOCK_SHINGLES are cut into blocks of that size;
cluster heads, then all documents outside the largest cluster, are dealt into blocks of that size too,
and each of these meets each other block in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

WORDS = 5
PERCENT = 75
COORDINATES = 128
TREES = 20
DEPTH = 3
SMALL = 128
#: Tokens that must agree for a candidate: about 4.5 standard deviations below the mean at PERCENT.
AGREEING = 74
BLOCK_SHINGLES = 2_000_000
#: Documents of a block of a node.
NODE_BLOCK = 8192
#: The size of a node of more documents than this is sent to its documents.
LARGE_NODE = 500
_WORDS_HELD = 150_000

_U = np.uint64
_RNG = np.random.default_rng(17)
_FACTORS = _RNG.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_STEPS = _RNG.integers(1, 1 << 62, WORDS).astype(_U) * _U(2) + _U(1)
_CHOSEN = _U(int((1 << 64) * 100 / PERCENT / COORDINATES))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _word_hashes() -> common.BoundedCache:
    return common.BoundedCache(xxhash.xxh3_64_intdigest, _WORDS_HELD)


def shingles(text: str, word_hash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. A-Z are lower-cased; words are what
    stands between ASCII white space; with fewer than WORDS words all of them are one shingle."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, _U)
    hashes = np.fromiter(map(word_hash.__getitem__, words), _U, len(words))
    width = min(WORDS, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, _U)
    for k in range(width):
        total = _mixed(total * _STEPS[k] + hashes[k : k + count])
    return np.unique(total)


def _tokens(own: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    short = (own >> _U(32)).astype(np.uint32)
    for i in range(0, len(short), 8192):
        x = _FACTORS[:, None] * short[None, i : i + 8192]
        x += _OFFSETS[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _children(keys: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """For row r, the nodes below node keys[r] on the paths that tokens[r] choose."""
    named = _mixed(tokens.astype(_U) | (np.arange(COORDINATES, dtype=_U) << _U(32)))
    below = _mixed(keys[:, None] + named)
    chosen = _mixed(below ^ _U(0x5851F42D4C957F2D)) < _CHOSEN
    return [below[r][chosen[r]] for r in range(len(keys))]


_ROOTS = _mixed(np.arange(1, TREES + 1, dtype=_U))


def sketches(docs: DataFrame) -> DataFrame:
    """`id, n_shingles, digest, tokens, nodes` of `id, text`: set size, digest of the set (null for
    an empty one), tokens as bytes, and the document's nodes below the roots of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _word_hashes()
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sizes, digests, tokens, nodes = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, word_hash)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None), tokens.append(None), nodes.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                mine = _tokens(own)
                tokens.append(mine.tobytes())
                nodes.append(np.concatenate(_children(_ROOTS, np.broadcast_to(mine, (TREES, COORDINATES)))).view(np.int64))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(tokens, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "tokens", "nodes"],
            )

    return docs.mapInArrow(common.releasing(run), "id long, n_shingles long, digest binary, tokens binary, nodes array<long>")


def _expand(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, _ = common.lists(batch.column(2), np.uint32)
    below = _children(batch.column(0).to_numpy().view(_U), values.reshape(-1, COORDINATES))
    ids = np.repeat(batch.column(1).to_numpy(), [len(b) for b in below])
    return pa.record_batch([pa.array(np.concatenate(below).view(np.int64)), pa.array(ids)], names=["node", "id"])


def _clustered(n: int, size_of: np.ndarray, links_of: Callable[[int], np.ndarray]) -> np.ndarray:
    """Cluster (smallest member) of 0..n-1, where links_of(i) are all nodes linked with i.

    Stops when all outside the largest cluster have been asked.
    """
    label, asked = np.arange(n), np.zeros(n, bool)
    while True:
        largest = np.bincount(label, size_of, n).argmax()
        left = np.flatnonzero((label != largest) & ~asked)
        if not len(left):
            return label
        i = left[0]
        asked[i] = True
        met = np.unique(label[np.append(links_of(i), i)])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]


def _node_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links `a, b` so that all documents of a block of a node that may be similar are connected, or, at
    a `visit`, each visitor (`guest`) with the block's own."""
    names = ["a", "b"]
    for group in common.groups(batches, 3):
        n = group.num_rows
        values, _ = common.lists(group.column(4), np.uint8)
        tokens = values.reshape(n, COORDINATES)
        ids = group.column(3).to_numpy()
        guest = group.column(5).to_numpy(zero_copy_only=False)
        if group.column(2)[0].as_py() >= 0:
            yield from _visitor_links(
                ids, guest, lambda p: np.flatnonzero(np.count_nonzero(tokens == tokens[p], axis=1) >= AGREEING)
            )
            continue
        if n <= 32:
            close = np.count_nonzero(tokens[:, None] == tokens[None], axis=2) >= AGREEING
            i, j = np.nonzero(np.triu(close, 1))
            if not len(i):
                continue
            label = common.clusters(n, i, j) if len(i) > 1 else np.where(np.arange(n) == j[0], i[0], np.arange(n))
        else:
            label = _clustered(
                n, np.ones(n), lambda p: np.flatnonzero(np.count_nonzero(tokens == tokens[p], axis=1) >= AGREEING)
            )
        moved = np.flatnonzero(label != np.arange(n))
        if len(moved):
            yield pa.record_batch([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=names)


def _visitor_links(ids: np.ndarray, guest: np.ndarray, links_of: Callable[[int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links `a, b` that connect each visitor with those of the block's own it is linked with: one with
    each cluster that former links have made of these."""
    label = np.arange(len(ids))
    for i in np.flatnonzero(guest):
        met = links_of(i)
        met = met[~guest[met]]
        _, first = np.unique(label[met], return_index=True)
        if len(first):
            ends = met[first]
            label[np.isin(label, label[np.append(ends, i)])] = label[i]
            yield pa.record_batch([pa.array(np.full(len(ends), ids[i])), pa.array(ids[ends])], names=["a", "b"])


class _Sets:
    """The full sets of a group, for intersections of one with all."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.sizes = np.diff(offsets)
        shared, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        several = counts[codes] > 1  # the others are in no intersection
        self.codes, self.owner = codes[several], owner[several]
        self.starts = np.searchsorted(self.owner, np.arange(len(self.sizes) + 1))
        self.marks = np.zeros(len(shared), bool)

    def linked(self, i: int) -> np.ndarray:
        own = self.codes[self.starts[i] : self.starts[i + 1]]
        self.marks[own] = True
        common_size = np.bincount(self.owner, self.marks[self.codes], len(self.sizes))
        self.marks[own] = False
        return np.flatnonzero(100 * common_size >= PERCENT * (self.sizes + self.sizes[i] - common_size))


def _set_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links `a, b` that connect what is linked in each block of a group: all of its documents, or,
    at a `visit`, each visitor (`guest`) with the block's own."""
    for group in common.groups(batches, 3):
        ids = group.column(3).to_numpy()
        guest = group.column(5).to_numpy(zero_copy_only=False)
        if len(ids) < 2:
            continue
        sets = _Sets(*common.lists(group.column(4), _U))
        if group.column(2)[0].as_py() >= 0:
            yield from _visitor_links(ids, guest, sets.linked)
            continue
        label = _clustered(len(ids), np.ones(len(ids)), sets.linked)
        a = np.flatnonzero(label != np.arange(len(ids)))
        if len(a):
            yield pa.record_batch([pa.array(ids[a]), pa.array(ids[label[a]])], names=["a", "b"])


def _linked(rows: DataFrame, compare) -> DataFrame:
    """Links `a, b` that `compare` finds among `grp, block, visit, id, own, guest`."""
    columns = ["grp", "block", "visit", "id", "own", "guest"]
    return common.hosted(rows.select(*columns), columns[:3]).mapInArrow(common.releasing(compare), "a long, b long")


def _alone(rows: DataFrame) -> DataFrame:
    """Rows of blocks without visitors."""
    return rows.withColumn("visit", F.lit(-1)).withColumn("guest", F.lit(False))


def _across(links: DataFrame, large: DataFrame, limit: int, compare) -> DataFrame:
    """`links` and those that connect what is linked between the blocks of each group of `large` (`grp,
    id, block, blocks, size, own`, written), where `links` connect what is linked inside the blocks.

    Visitors are dealt into blocks of about `limit` by their `size`, so a task holds two such blocks.
    """
    for heads_only in (True, False):
        at = large.select("grp", "id", "size").join(common.components(links), "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        )
        if heads_only:
            heads = at.groupBy("grp", "component").agg(F.min(F.struct("id", "size")).alias("h"))
            guests = heads.select("grp", "h.id", "h.size")
        else:
            counts = at.groupBy("grp", "component").agg(F.count("*").alias("n"))
            main = counts.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("m")).select("grp", F.col("m.component").alias("main"))
            guests = at.join(main, "grp").filter(F.col("component") != F.col("main")).select("grp", "id", "size")
        guests = common.cut(guests)
        visits = guests.groupBy("grp").agg(F.ceil(F.sum("size") / limit).cast("int").alias("visits"))
        dealt = guests.select("grp", "id").join(visits, "grp").select(
            "grp", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("visits")).cast("int").alias("visit")
        )
        hosts = large.join(visits, "grp").withColumn("visit", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
        visitors = large.join(dealt, ["grp", "id"]).withColumn(
            "block", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block")))
        )
        columns = ["grp", "block", "visit", "id", "own", "guest"]
        both = hosts.withColumn("guest", F.lit(False)).select(*columns).unionByName(
            visitors.withColumn("guest", F.lit(True)).select(*columns)
        )
        links = common.cut(links.unionByName(_linked(both, compare)))
    return links


def _with_sizes(rows: DataFrame) -> DataFrame:
    """`node, id, n` of `node, id`: with the number of documents of the node, where that is more than one.

    The rows of a large node stay where they are: large nodes are few, so their sizes go to the rows. All other
    nodes fit in a task.
    """
    sizes = common.cut(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    large = sizes.filter(F.col("n") > LARGE_NODE)
    marked = scale.lookup_join(rows, large, "node", "left", spread_by=F.col("id"))
    rest = marked.filter(F.col("n").isNull()).drop("n").join(sizes.filter(F.col("n") <= LARGE_NODE), "node")
    return marked.filter(F.col("n").isNotNull()).unionByName(rest)


def _nodes(classes: DataFrame) -> DataFrame:
    """`node, id` of all nodes to compare, with at least two documents each."""
    rows, done = classes.select(F.explode("nodes").alias("node"), "id"), None
    for depth in range(1, DEPTH + 1):
        rows = common.cut(_with_sizes(rows))
        leaves = rows if depth == DEPTH else rows.filter(F.col("n") <= SMALL)
        done = leaves if done is None else done.unionByName(leaves)
        rows = rows.filter(F.col("n") > SMALL)
        if depth == DEPTH or rows.isEmpty():
            return done
        rows = rows.select("node", "id").join(classes.select("id", "tokens"), "id").select("node", "id", "tokens").mapInArrow(
            common.per_batch(_expand), "node long, id long"
        )
    return done


def candidate_groups(classes: DataFrame) -> DataFrame:
    """`id, grp`: groups of classes outside which no class has a similar one."""
    def short(batch):
        values, _ = common.lists(batch.column(1), np.uint32)
        each = values.astype(np.uint8).reshape(batch.num_rows, COORDINATES)
        return pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in each], pa.binary())], names=["id", "tokens"])

    brief = classes.select("id", "tokens").mapInArrow(common.per_batch(short), "id long, tokens binary")
    blocks = F.ceil(F.col("n") / NODE_BLOCK).cast("int")
    placed = _nodes(classes).select(
        F.col("node").alias("grp"), "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "node"), blocks).cast("int").alias("block"),
        F.lit(1).alias("size"),
    )
    met = placed.join(brief.withColumnRenamed("tokens", "own"), "id")
    links = common.cut(_linked(_alone(met), _node_candidates).distinct())
    if not placed.filter(F.col("blocks") > 1).isEmpty():
        links = _across(links, common.cut(met.filter(F.col("blocks") > 1)), NODE_BLOCK, _node_candidates)
    return common.components(links).withColumnRenamed("component", "grp")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id, n_shingles, component_id, kept`.

    `component_id` is the smallest id that links lead to. A null text, or one without words, has an
    empty set and links with nothing. A null id has a null component and is not kept. Rows that
    repeat an id are one document; if their texts differ, one of them (by digest) stands for all.
    """
    texts = common.keyed_texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    rows = common.cut(sketches(texts))
    known = rows.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    heads = known.groupBy("digest").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("digest").alias("digest"))
    classes = common.cut(known.join(heads, ["id", "digest"], "left_semi").dropDuplicates(["id"]))
    groups = candidate_groups(classes)
    links = exact_links(texts, classes.select("id", "digest", "n_shingles").join(groups, "id"))
    linked = common.components(links)
    by_set = known.groupBy("digest").agg(F.min("id").alias("id")).join(linked, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    out = rows.select("id", "n_shingles", "digest").join(by_set, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        "id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


def exact_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Links `a, b` that connect, by similar full sets, what is linked inside every group of
    `members` (`id, digest, n_shingles, grp`)."""
    weight = members.groupBy("grp").agg(F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    placed = members.join(weight, "grp").select(
        "id", "digest", "grp", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
        F.col("n_shingles").alias("size"),
    )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _word_hashes()
        names = ["grp", "block", "id", "own", "blocks", "size"]
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            own = [shingles(text, word_hash).tobytes() for text in batch.column(6).to_pylist()]
            keep = [d == xxhash.xxh3_128_digest(o) for d, o in zip(batch.column(5).to_pylist(), own)]
            out = pa.record_batch([*batch.columns[:3], pa.array(own, pa.binary()), *batch.columns[3:5]], names=names)
            yield out.filter(pa.array(keep, pa.bool_()))

    sets = placed.join(texts, "id").select("grp", "block", "id", "blocks", "size", "digest", "text").mapInArrow(
        full, "grp long, block int, id long, own binary, blocks int, size long"
    )
    several = not placed.filter(F.col("blocks") > 1).isEmpty()
    if several:
        sets = common.cut(sets)
    links = common.cut(_linked(_alone(sets), _set_links))
    if not several:
        return links
    return _across(links, sets.filter(F.col("blocks") > 1), BLOCK_SHINGLES, _set_links)


def op4_near(spark, sf_dir):
    return similar(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def keep_one_of_group(spark, docs, sf_dir):
    """Pipeline stage: one row of each group of near copies, the one with the smallest id, a null id last, and
    any one of those where that id repeats. Texts without words stay.

    Rows are dropped, not ids: rows that share an id are compared as documents of their own. All columns
    are kept.
    """
    if common.ids_are_keys(docs) and dict(docs.dtypes)["doc_id"] == "bigint":
        gone = similar(docs).filter(~F.col("kept")).select(F.col("id").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti")
    rows, row = common.with_row(docs)
    found = similar(rows, row).select(F.col("id").alias(row), "component_id")
    named = found.join(rows.select(row, "doc_id"), row)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    stay = named.groupBy("component_id").agg(F.min_by(row, order).alias("stays")).select(F.col("stays").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
