"""Near duplicates among embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and fast Hadamard transforms; its hash is the
axis, with sign, that it lies closest to. A table joins `width` such hashes into a bucket; each
vector lives in one bucket per table and also visits the buckets of its next best axes. Whatever
meets is compared exactly. A pair that meets more than once counts where it meets first, so no pair
ever becomes a row: buckets give link counts per vector and one link per vector for the components.
Buckets are cut into blocks that are compared pair by pair, so their size has no limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

THRESHOLD = 0.93
PROBES = 2
#: A link at the threshold is missed with about this probability.
MISS = 1e-6
#: Rows of a label in a bucket that the width aims at, and rows of a block.
BUCKET, BLOCK = 256, 1024
_SEED = 5


def _transform(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(n, size // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(n, size)


@lru_cache(maxsize=64)
def _signs(size: int, table: int, position: int) -> np.ndarray:
    return np.random.default_rng((_SEED, size, table, position)).choice([-1.0, 1.0], (3, size))


def bucket_codes(vectors: np.ndarray, width: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Codes of shape (vectors, tables, 1 + probes): the own bucket, then the visited ones."""
    n, dim = vectors.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    codes = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        own, swaps, losses = np.zeros(n, np.int64), [], []
        for k in range(width):
            turned = padded
            for signs in _signs(size, t, k):
                turned = _transform(turned * signs) / math.sqrt(size)
            length = np.abs(turned)
            best = np.argsort(-length, axis=1, kind="stable")[:, : probes + 1]
            if best.shape[1] <= probes:
                best = np.pad(best, ((0, 0), (0, probes + 1 - best.shape[1])), mode="edge")
            vertex = 2 * best + (turned[rows[:, None], best] < 0)
            scale_k = (2 * size) ** k
            own += vertex[:, 0] * scale_k
            swaps.append((vertex[:, 1:] - vertex[:, :1]) * scale_k)
            losses.append(length[rows, best[:, 0]][:, None] - length[rows[:, None], best[:, 1:]])
        swap, loss = np.concatenate(swaps, axis=1), np.concatenate(losses, axis=1)
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        codes[:, t, 0] = own
        codes[:, t, 1:] = own[:, None] + swap[rows[:, None], chosen]
    return codes


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether code lists meet, per pair and table: one's own bucket is owned or visited by the other."""
    return (a[..., :1] == b).any(-1) | (b[..., :1] == a).any(-1)


@lru_cache(maxsize=16)
def tables_needed(dim: int, width: int, threshold: float, miss: float = MISS) -> int:
    """Tables so that a pair at the threshold meets in one of them but for probability `miss`, by simulation."""
    rng = np.random.default_rng(_SEED)
    a, b = rng.standard_normal((2, 2000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1)[:, None], 1e-12)
    close = threshold * a + math.sqrt(1 - threshold**2) * b
    found = _meets(bucket_codes(a, width, 1), bucket_codes(close, width, 1)).mean()
    return max(2, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - min(found, 0.999)))))


def _unit(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    vectors = values.reshape(len(offsets) - 1, -1)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _bucket_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.groups(batches, 3):
            b1, b2 = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            column = {name: group.column(i) for i, name in enumerate(group.schema.names)}
            block, table, code = (column[c].to_numpy() for c in ("block", "table", "code"))
            ids, weights, labels = (column[c].to_numpy() for c in ("id", "weight", "label"))
            unit = _unit(*common.lists(column["vector"], np.float64))
            values, offsets = common.lists(column["codes"], np.int64)
            tables = int(column["tables"][0].as_py())
            codes = values.reshape(len(ids), tables, -1)
            left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
            close = unit[left] @ unit[right].T >= threshold
            if b1 == b2:
                close &= np.arange(len(left))[:, None] < np.arange(len(right))
            i, j = np.nonzero(close)
            i, j = left[i], right[j]
            keep = []
            for part in np.array_split(np.arange(len(i)), max(1, len(i) // 100_000)):
                a, b = codes[i[part]], codes[j[part]]
                t, own = table[i[part]], code[i[part]]
                rows = np.arange(len(part))
                met = _meets(a, b)
                first = met.argmax(axis=1) == t
                a, b = a[rows, t], b[rows, t]
                # In a table a pair meets in the own bucket of one of them, of the first by code if in both;
                # where both only visit, it does not count.
                a_seen, b_seen = (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)
                a, b = a[:, 0], b[:, 0]
                here = met[rows, t] & (own == np.where(a_seen & b_seen, np.minimum(a, b), np.where(a_seen, a, b)))
                keep.append(first & here & (table[j[part]] == t) & (code[j[part]] == own) & (labels[i[part]] == labels[j[part]]))
            keep = np.concatenate(keep)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            root = ids[order][common.clusters(len(ids), place[i], place[j])][place]
            found = np.flatnonzero(links)
            yield pa.record_batch(
                [pa.array(ids[found]), pa.array(links[found].astype(np.int64)), pa.array(root[found])],
                names=["id", "links", "root"],
            )

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """One row per row of `rows` (`id` long, `vector` array of float or double, `label` int or long):
    `id, n_links, component_id, kept`.

    Only vectors with equal labels and lengths are compared. A row with a null label or a null,
    empty or zero vector, or one with null or non-finite components, links with nothing; so does
    one with a null id. Equal vectors are linked; one of them is hashed for all. Where an id is
    repeated with different vectors, its rows count as one vector of several directions.
    """
    source = rows.select(
        F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"),
        F.col("label").cast("long").alias("label"),
    )
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    valid = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0)
    )
    usable = source.filter(F.coalesce(valid, F.lit(False)))
    classes = common.cut(
        usable.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .withColumn("dim", F.size("vector"))
    )
    largest = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    plan = {}
    for row in largest:  # one row per vector length
        sides = 2 << max(1, (row["dim"] - 1).bit_length())
        width = max(1, math.ceil(math.log(max(1, row["n"] / BUCKET)) / math.log(sides)))
        plan[row["dim"]] = (width, tables_needed(row["dim"], width, threshold, miss))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "weight", "label", "dim", "vector"]
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                width, tables = plan[dim]
                for part in (batch.take(pa.array(x)) for x in np.array_split(np.flatnonzero(dims == dim), len(dims) // 2000 + 1) if len(x)):
                    values, offsets = common.lists(part.column(4), np.float64)
                    codes = bucket_codes(_unit(values, offsets), width, tables)
                    n = part.num_rows
                    yield pa.record_batch(
                        [*[part.column(k) for k in range(5)], pa.array(np.full(n, tables, np.int32)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes[0].size), pa.int32()),
                                                  pa.array(codes.reshape(-1)))],
                        names=[*names, "tables", "codes"],
                    )

    placed = common.cut(classes.select("id", "weight", "label", "dim", "vector").mapInArrow(
        place, "id long, weight long, label long, dim int, vector array<double>, tables int, codes array<long>"
    ))
    each = 1 + PROBES
    spots = placed.select("*", F.posexplode(F.array_distinct(F.transform(
        "codes", lambda c, i: F.struct(F.floor(i / each).cast("int").alias("table"), c.alias("code"))
    ))).alias("_spot", "spot")).select("*", "spot.table", "spot.code").drop("spot", "_spot")
    spots = spots.withColumn("cell", F.xxhash64("label", "dim", "table", "code"))
    crowded = (
        spots.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
        .select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    cells = scale.lookup_join(spots, common.cut(crowded), "cell", "left", spread_by=F.col("id"))
    block = F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(
        F.least(o, F.col("block")).alias("b1"), F.greatest(o, F.col("block")).alias("b2")
    ))
    meetings = cells.withColumn("block", block).withColumn("pair", F.explode(pairs)).select(
        "cell", "pair.b1", "pair.b2", "block", "table", "code", "id", "weight", "label", "vector", "tables", "codes"
    )
    found = common.cut(common.hosted(meetings, ["cell", "b1", "b2"]).mapInArrow(
        _bucket_links(threshold), "id long, links long, root long"
    ))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = common.components(
        found.filter(F.col("id") != F.col("root")).select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    )
    result = classes.select("label", "vector", "id", "weight").join(counts, "id", "left").join(linked, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    ok = F.coalesce(valid, F.lit(False))
    keyed = source.withColumn("label", F.when(ok, F.col("label"))).withColumn("vector", F.when(ok, F.col("vector")))
    return keyed.join(result, ["label", "vector"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def op9_vectors(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings")
    return near_vectors(
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    ).withColumnRenamed("id", "vec_id")


OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.e, b.e) / (a.size * b.size) >= {THRESHOLD}
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id)
"""
