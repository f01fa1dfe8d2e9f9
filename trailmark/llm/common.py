"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import session
from trailmark.operators import graph

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id, text` alone, so that no other column of `docs` can clash; a null text is empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few texts are Python objects at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def release() -> None:
    """Gives freed memory back: worker processes outlive their tasks, and an executor holds several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that gives memory back when its task has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function that turns one batch into one batch, a few hundred rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return releasing(run)


class BoundedCache(dict):
    """A dict that computes missing values and remembers about `size` of those last used.

    It holds two generations of half that size; what is used of the old one moves to the new one.
    """

    def __init__(self, compute: Callable, size: int):
        super().__init__()
        self._compute, self._size, self._old = compute, size // 2, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Folders that `cut` wrote in this process, oldest first.
WRITTEN: list[str] = []


def ids_are_keys(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id is null or repeats."""
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return ids.filter((F.col("n") > 1) | F.col("id").isNull()).isEmpty()


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number of its own for every row, written so that it never changes, and that column's name."""
    name = unused("_row", docs.columns)
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{session.scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that `cut` wrote. Only for when no result that was not written yet reads them."""
    jvm = spark._jvm
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree in the first `keys` columns (non-null integers), each as one batch.
    Rows of a run must follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changed = np.zeros(batch.num_rows - 1, bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        first = tuple(v[0] for v in values)
        if held and first != last:
            yield _joined(held)
            held = []
        begin = 0
        for end in (np.flatnonzero(changed) + 1).tolist():
            yield _joined([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        held.append(batch.slice(begin))
        last = tuple(v[-1] for v in values)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def lists(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list or binary column, sliced or not; binary is read as `dtype`."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if pa.types.is_binary(column.type):
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        size = np.dtype(dtype).itemsize
        return np.frombuffer(raw.tobytes(), dtype), (offsets - offsets[0]).astype(np.int64) // size
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(dtype, copy=False), (offsets - offsets[0]).astype(np.int64)


def clusters(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node of each node's cluster."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return label
        label = new


def hosted(df: DataFrame, keys: list[str], order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """`df` dealt by `keys` and sorted by them, for `groups`."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *(order or []))


def components(links: DataFrame) -> DataFrame:
    """`id, component` of every node in `links` (`a, b`): the smallest id of its connected component."""
    nodes = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct()
    return graph.components(nodes, links).select(F.col("key").alias("id"), "component")
