"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes meets a pattern, so equal stretches are cut
alike wherever they stand. Each distinct chunk gets a 64-bit identifier; an identifier is verified
if one chunk alone has it. A document's recipe is the ordered list of its identifiers; documents are
compared by recipe, and only recipes travel. Documents with an unverified identifier are compared by
their whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common

#: Chunk sizes in bytes: a cut is sought from the least on, expected after MEAN more, made at the most.
LEAST, MEAN, MOST = 512, 4096, 65536
_GEAR = np.random.default_rng(20240131).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of `data`, the last one its length; none for empty data."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these, h[i] depends on the 32 bytes up to i
        h[step:] += h[:-step] << np.uint32(step)
    found = np.flatnonzero((h >> np.uint32(16)) % np.uint32(mean) == 0) + 1
    ends, last = [], 0
    for cut in found.tolist():
        while cut - last > most:
            last += most
            ends.append(last)
        if cut - last >= least and cut < n:
            ends.append(cut)
            last = cut
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n]


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, sha, recipe, chunks`: digest of the normalised text (A-Z lower-cased, UTF-8), and the
    identifier and bytes of each chunk. A null text is empty and has no chunks."""

    def run(batch):
        shas, recipes, chunks = [], [], []
        for text in batch.column(1).to_pylist():
            data = text.encode("utf-8").lower()  # bytes.lower() changes A-Z alone
            cuts = boundaries(data)
            parts = [data[a:b] for a, b in zip([0, *cuts], cuts)]
            shas.append(hashlib.sha256(data).hexdigest())
            chunks.append(parts)
            recipes.append([xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in parts])
        return pa.record_batch(
            [batch.column(0), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64())),
             pa.array(chunks, pa.list_(pa.binary()))],
            names=["id", "sha", "recipe", "chunks"],
        )

    texts = common.keyed_texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        common.per_batch(run), f"id {kind}, sha string, recipe array<long>, chunks array<binary>"
    )


def unverified(chunks: DataFrame) -> DataFrame:
    """`chunk`: identifiers that stand for more than one chunk. Copies of a chunk meet in the task
    that made them first, so a hot chunk travels once per task."""
    distinct = chunks.select(F.explode(F.arrays_zip("recipe", "chunks")).alias("c")).select(
        F.col("c.recipe").alias("chunk"), F.col("c.chunks").alias("data")
    ).distinct()
    return distinct.groupBy("chunk").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("chunk")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id, keep_id, group_size, kept, text_sha256`.

    Of equal texts the row with the largest id stays; a null id is less than all others. Of rows
    that repeat the largest id each counts as kept, since they are the same document. Null and empty texts
    are equal.
    """
    chunks = common.cut(chunked(docs, id_col, text_col))
    recipes = chunks.select("id", "sha", "recipe")
    clashes = common.cut(unverified(chunks))
    if not clashes.isEmpty():
        tainted = (
            recipes.select("sha", F.explode("recipe").alias("chunk")).join(clashes, "chunk", "left_semi")
            .select("sha").distinct()
            .withColumn("tainted", F.lit(True))
        )
        recipes = recipes.join(tainted, "sha", "left")
        whole = chunks.select("id", "sha", F.expr("aggregate(chunks, X'', (a, c) -> concat(a, c))").alias("data"))
        key = whole.join(tainted, "sha", "left_semi").select("sha", "data").distinct()
        recipes = recipes.join(key, "sha", "left").select(
            "id", "sha", "recipe", F.when(F.col("tainted"), F.col("data")).alias("data")
        )
    else:
        recipes = recipes.withColumn("data", F.lit(None).cast("binary"))
    keys = ["n_chunks", "recipe", "data"]
    recipes = recipes.withColumn("n_chunks", F.size("recipe")).withColumn("data", F.coalesce("data", F.lit(b"")))
    groups = recipes.groupBy(*keys).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = recipes.join(groups, keys)
    return joined.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact(spark, sf_dir):
    return duplicates(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def keep_last_copy(spark, docs, sf_dir):
    """Pipeline stage: one row of each group of equal texts (A-Z lower-cased; null is empty), the one with the
    largest id, and any one of those where that id repeats; a null id is less than all others.

    Rows are dropped, not ids: a text stays even if its id is that of a dropped row. All columns are kept.
    """
    if common.ids_are_keys(docs):
        gone = duplicates(docs).filter(~F.col("kept")).select(F.col("id").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti")
    rows, row = common.with_row(docs)
    keyed = rows.select(F.struct(F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("key"), "text")
    gone = duplicates(keyed, "key").filter(~F.col("kept")).select(F.col("id.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
