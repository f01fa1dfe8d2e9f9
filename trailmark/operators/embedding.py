"""Embedders, vector tables and exact nearest-neighbour search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from trailmark.functions import text as T
from trailmark.functions import vectors as V
from trailmark.operators import scale

MAX_PROTOTYPES = 10_000
DEFAULT_DIM = 64
# Bytes of vectors of either side that meet in one cell of a search, and what a cell is not cut below.
CELL_BYTES, MIN_CELL_BYTES = 64_000_000, 250_000
# Queries and vectors whose scores are held at once inside a cell.
TILE = 1024
_MAX_CACHED_TERMS = 200_000


@dataclass(frozen=True)
class Embedder:
    """A model hook: `load` runs once per Python worker and returns list[str] -> (n, dim) array.

    `fingerprint` names the model; stored vectors carry it. The UDFs are declared non-deterministic
    so that the optimizer neither copies a model call nor moves a filter on its result below it.
    """

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int
    fingerprint: str

    def vector(self, text: Column, nulls: bool = False, fail_open: bool = False) -> Column:
        """array<float> per text. A null text is embedded as an empty one or, with `nulls`, has no vector and
        does not reach the model. With `fail_open` a failing model gives nulls instead of an error."""
        load = self.load

        def vectors_of(model, texts: list[str]) -> list:
            try:
                return list(np.asarray(model(texts), dtype=np.float32)) if texts else []
            except Exception:
                if fail_open:
                    return [None] * len(texts)
                raise

        @F.pandas_udf(st.ArrayType(st.FloatType()))
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                out = np.full(len(texts), None, dtype=object)
                wanted = np.flatnonzero(texts.notna()) if nulls else np.arange(len(texts))
                for place, vector in zip(wanted, vectors_of(model, [texts.iloc[i] or "" for i in wanted])):
                    out[place] = vector
                yield pd.Series(out)

        return embed.asNondeterministic()(text)

    def adjacent_similarity(self, texts: Column) -> Column:
        """array<double> of cosines between neighbours of an array<string>; null when embedding fails."""
        load = self.load

        @F.pandas_udf(st.ArrayType(st.DoubleType()))
        def compare(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()

            def neighbours(row) -> list[float] | None:
                if row is None or len(row) < 2:
                    return []
                try:
                    m = np.asarray(np.asarray(model(list(row)), dtype=np.float32), dtype=np.float64)
                except Exception:
                    return None
                lengths = np.linalg.norm(m, axis=1)
                scale = lengths[:-1] * lengths[1:]
                dots = np.einsum("ij,ij->i", m[:-1], m[1:])
                return np.round(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), 9).tolist()

            for rows in batches:
                yield pd.Series([neighbours(r) for r in rows])

        return compare.asNondeterministic()(texts)


def hash_embedder(dim: int = DEFAULT_DIM) -> Embedder:
    """Signed feature hashing of search terms, L2-normalised: the stand-in for a model."""

    def load() -> Callable[[list[str]], np.ndarray]:
        token = re.compile(r"[^\W_]+")
        plain = str.maketrans(T.ACCENTED, T.PLAIN)
        slots: dict[str, tuple[int, float]] = {}

        def slot(term: str) -> tuple[int, float]:
            if len(slots) > _MAX_CACHED_TERMS:
                slots.clear()
            digest = hashlib.md5(term.encode()).hexdigest()
            slots[term] = (int(digest[:8], 16) % dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0)
            return slots[term]

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                terms = token.findall(text.lower().translate(plain))
                if terms:
                    places, signs = zip(*[slots.get(t) or slot(t) for t in terms])
                    out[row] = np.bincount(places, weights=signs, minlength=dim)
            lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, lengths, out=out, where=lengths > 0)

        return embed

    return Embedder(load, dim, f"hash{dim}")


def embed_queries(queries: DataFrame, embedder: Embedder, model: str = "", query_col: str = "query") -> DataFrame:
    """`query_id, vector`; the model's query instruction goes in front of queries only."""
    text = F.concat(F.lit(T.query_instruction(model)), F.col(query_col))
    return queries.select("query_id", embedder.vector(text).alias("vector"))


def embed_chunks(chunks: DataFrame, embedder: Embedder, keep: tuple[str, ...] = ()) -> DataFrame:
    """`chunk_id, vector, fingerprint` from the title, URL and text of each chunk, and the columns `keep`."""
    prefix = T.context_prefix(F.col("page_title"), F.col("page_url"))
    return chunks.select(
        "chunk_id",
        embedder.vector(T.embedding_text(prefix, F.col("text"))).alias("vector"),
        F.lit(embedder.fingerprint).alias("fingerprint"), *keep,
    )


def upsert_vectors(current: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Rows of `current` replaced by chunk id; a row of the wrong dimension fails the job."""
    width = F.size("vector")
    checked = new.withColumn(
        "vector",
        F.when(width == dim, F.col("vector")).otherwise(
            F.raise_error(F.concat(F.lit("vector dimension "), width.cast("string"), F.lit(f", expected {dim}")))
        ),
    )
    return delete_vectors(current, new.select("chunk_id")).unionByName(checked)


def delete_vectors(current: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    return current.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def orphans(old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunk ids of the old set that the new set no longer has."""
    return old_chunks.select("chunk_id").distinct().join(new_chunks.select("chunk_id"), "chunk_id", "left_anti")


def reembed(chunks: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors under the embedder's fingerprint: rows already made with it are kept, the rest embedded."""
    fresh = vectors.filter(F.col("fingerprint") == embedder.fingerprint)
    stale = chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    kept = fresh.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return kept.unionByName(embed_chunks(stale, embedder))


def centroids(vectors: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """L2-normalised mean vector per key; keys whose mean is zero are left out.

    Vectors are summed as wholes, one partial sum per key and task before the shuffle. Null vectors, and those
    with a null component, are left out; all others of a key must have the same dimension.
    """
    usable = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())
    summed = vectors.filter(usable).select(key, array_to_vector(F.col(vector_col).cast("array<double>")).alias("v")).groupBy(key).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mean")
    ).withColumn("length", V.norm(F.col("mean")))
    return summed.filter(F.col("length") > 0).select(
        key, F.transform("mean", lambda x: x / F.col("length")).alias("vector")
    )


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column as rows of length 1, or 0 where they are zero."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(lists), -1)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _by_direction(matrix: np.ndarray) -> np.ndarray:
    """An order that puts vectors of the same main direction together."""
    main = np.abs(matrix).argmax(axis=1)
    return np.lexsort((-np.abs(matrix[np.arange(len(matrix)), main]), 2 * main + (matrix[np.arange(len(matrix)), main] > 0)))


def top_of_cell(
    queries: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, digits: int,
    query_side: np.ndarray | None = None, vector_side: np.ndarray | None = None, tile: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the `k` vectors nearest to each query, both queries x k: best score first, then by
    `order`, the rank of a vector among equals; place -1 where there are fewer. Pairs of equal sides do not count.

    Scores are worked out tile by tile, `tile` x `tile` at a time. All vectors of a tile lie within a radius of its
    centre, which bounds their score; a tile that cannot reach the k-th score of any query of the other tile
    is skipped.
    """
    tile = tile or TILE
    n = len(queries)
    scores, places = np.full((n, k), -1.0), np.full((n, k), -1, np.int64)
    tiles = []
    for begin in range(0, len(vectors), tile):
        part = vectors[begin : begin + tile]
        centre = part.mean(axis=0)
        tiles.append((begin, part, centre, np.linalg.norm(part - centre, axis=1).max()))
    for first in range(0, n, tile):
        q = queries[first : first + tile]
        own, where = scores[first : first + tile], places[first : first + tile]
        bounds = [np.maximum(q @ centre + radius, 0.0) for _, _, centre, radius in tiles]
        for at in np.argsort([-b.max() for b in bounds], kind="stable"):
            begin, part, _, _ = tiles[at]
            open_rows = np.flatnonzero(bounds[at] + 10.0**-digits >= own[:, -1])
            if not len(open_rows):
                continue
            found = np.round(np.maximum(q[open_rows] @ part.T, 0.0), digits)
            if query_side is not None:
                found[query_side[first + open_rows][:, None] == vector_side[None, begin : begin + len(part)]] = -1.0
            # All that can enter a list, its ties included, meets the list; order settles ties.
            rows, columns = np.nonzero((found >= np.maximum(own[open_rows, -1], 0.0)[:, None]))
            if not len(rows):
                continue
            if len(rows) > 4 * k * len(open_rows):
                kth = -np.partition(-found, min(k, found.shape[1]) - 1, axis=1)[:, min(k, found.shape[1]) - 1]
                keep = found[rows, columns] >= kth[rows]
                rows, columns = rows[keep], columns[keep]
            touched = np.unique(rows)
            all_rows = np.concatenate([rows, np.repeat(touched, k)])
            all_scores = np.concatenate([found[rows, columns], own[open_rows[touched]].ravel()])
            all_places = np.concatenate([columns + begin, where[open_rows[touched]].ravel()])
            tie = np.where(all_places >= 0, order[all_places], np.iinfo(np.int64).max)
            sorted_ = np.lexsort((tie, -all_scores, all_rows))
            group = all_rows[sorted_]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            take = sorted_[(starts[:, None] + np.arange(k)).ravel()]
            own[open_rows[touched]] = all_scores[take].reshape(-1, k)
            where[open_rows[touched]] = all_places[take].reshape(-1, k)
    return scores, places


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, cell_bytes: int = CELL_BYTES, apart: str | None = None
) -> DataFrame:
    """Exact top-k cosine similarity (floored at 0): `query_id, chunk_id, score, rank`.

    Both sides are dealt into blocks of about `cell_bytes`, and every block of queries meets every block of vectors
    in a cell of a grid, where scores are worked out in tiles of fixed size (`top_of_cell`). A cell gives k
    rows per query; no query-vector pair is ever a row, and nothing is gathered on the driver. With `apart`, a column
    of both sides, vectors that have a query's value there do not count for it, and neither do null values.
    """
    extra = [apart] if apart else []
    queries = queries.select("query_id", "vector", *extra).filter(F.size("vector") > 0)
    vectors = vectors.select("chunk_id", "vector", *extra).filter(F.size("vector") > 0)
    if apart:
        queries, vectors = queries.filter(F.col(apart).isNotNull()), vectors.filter(F.col(apart).isNotNull())
    schema = st.StructType([
        queries.schema["query_id"], vectors.schema["chunk_id"], st.StructField("score", st.DoubleType())
    ])

    def size(rows: DataFrame) -> Column:
        return rows.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("n")).scalar()

    bytes_q, bytes_v = queries.sparkSession.range(1).select(size(queries), size(vectors)).first()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-bytes_q // cell_bytes))
    # Small tables are cut finer, so that all cores have a cell, but not below a tile's worth.
    v_blocks = max(1, -(-bytes_v // cell_bytes), min(cores // q_blocks, bytes_v // MIN_CELL_BYTES))

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = queries.withColumn("qb", block("query_id", q_blocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    right = vectors.withColumn("vb", block("chunk_id", v_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        names = schema.fieldNames()
        if not len(q) or not len(v):
            return pa.table([q.column("query_id").slice(0, 0), v.column("chunk_id").slice(0, 0), pa.array([], pa.float64())], names=names)
        unit = _units(v.column("vector"))
        along = _by_direction(unit)
        v, unit = v.take(pa.array(along)), unit[along]
        rank = np.empty(len(v), np.int64)
        rank[pc.sort_indices(v, [("chunk_id", "ascending")]).to_numpy()] = np.arange(len(v))
        sides = [None, None]
        if apart:
            coded = pa.concat_arrays([q.column(apart).combine_chunks(), v.column(apart).combine_chunks()]).dictionary_encode().indices.to_numpy()
            sides = [coded[: len(q)], coded[len(q) :]]
        scores, places = top_of_cell(_units(q.column("vector")), unit, rank, min(k, len(v)), digits, *sides)
        row, column = np.nonzero(places >= 0)
        good = scores[row, column] >= 0
        row, column = row[good], column[good]
        return pa.table([
            q.column("query_id").take(pa.array(row)), v.column("chunk_id").take(pa.array(places[row, column])),
            pa.array(scores[row, column]),
        ], names=names)

    local = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, schema)
    return scale.top_rows(local, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def prototype_gate(
    vectors: DataFrame,
    junk: DataFrame,
    content: DataFrame,
    margin: float = 0.02,
    vector_col: str = "vector",
) -> DataFrame:
    """Adds `junk_label, junk_margin, is_junk` by comparing each vector with two prototype sets.

    Prototypes are `label, vector` tables of at most MAX_PROTOTYPES rows, usually a dozen, which travel with
    the tasks. A missing or zero-length vector passes; without prototypes on both sides all do.
    """
    def bounded(rows: DataFrame) -> list:
        found = rows.filter(F.col("vector").isNotNull()).limit(MAX_PROTOTYPES + 1).collect()
        if len(found) > MAX_PROTOTYPES:
            raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
        return found

    junk_rows = sorted((r["label"], [float(x) for x in r["vector"]]) for r in bounded(junk))
    content_rows = [[float(x) for x in r["vector"]] for r in bounded(content)]
    if not junk_rows or not content_rows:
        return vectors.withColumns({
            "junk_label": F.lit(None).cast("string"), "junk_margin": F.lit(None).cast("double"), "is_junk": F.lit(False),
        })
    out = st.StructType([
        st.StructField("junk_label", st.StringType()), st.StructField("junk_margin", st.DoubleType())
    ])

    def unit(rows: list[list[float]]) -> np.ndarray:
        m = np.asarray(rows, dtype=np.float64)
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)

    junk_unit, content_unit = unit([v for _, v in junk_rows]), unit(content_rows)
    labels = np.array([label for label, _ in junk_rows], dtype=object)

    @F.pandas_udf(out)
    def assess(column: pd.Series) -> pd.DataFrame:
        dim = junk_unit.shape[1]
        usable = column.map(lambda v: v is not None and len(v) == dim)
        label = np.full(len(column), None, dtype=object)
        gap = np.full(len(column), np.nan)
        if usable.any():
            m = unit(_matrix(column[usable]))
            junk_sims = m @ junk_unit.T
            best = np.round(junk_sims, 9).argmax(axis=1)
            label[usable.to_numpy()] = labels[best]
            gap[usable.to_numpy()] = junk_sims[np.arange(len(m)), best] - (m @ content_unit.T).max(axis=1)
        return pd.DataFrame({"junk_label": label, "junk_margin": gap})

    judged = vectors.withColumn("_gate", assess(F.col(vector_col)))
    gap = F.when(F.isnan("_gate.junk_margin"), F.lit(None)).otherwise(F.col("_gate.junk_margin"))
    return (
        judged.withColumn("junk_label", F.col("_gate.junk_label"))
        .withColumn("junk_margin", F.round(gap, 6))
        .withColumn("is_junk", F.coalesce(F.col("junk_margin") > margin, F.lit(False)))
        .drop("_gate")
    )
