"""Ranked lexical search without an index of the documents.

The terms of all items form an Aho-Corasick automaton in which every term stands between two guards, so that
it is found only as a whole word. The automaton is sent to the tasks that scan the documents; it counts
the terms straight from the text, and its outputs map to items. A first scan writes the counts each document has
and what the scores need of the whole corpus; the second step scores from those counts.

Items are dealt into blocks whose terms one automaton may hold; every block scans all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

K = 20
#: An automaton is sent to every task: items are dealt into blocks of at most this many bytes of terms. An item
#: is never split.
BLOCK_BYTES = 8_000_000
#: Scores that a task holds at once, documents times items.
_TABLE = 4_000_000

_GUARD = 0x20
#: Separators to the guard, A-Z to lower case; bytes of other characters stay.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else _GUARD for b in range(256)
)


def folded(text: str) -> bytes:
    """The text's UTF-8 with separators as guards, and guards at both ends."""
    return b" " + text.encode("utf-8", "replace").translate(_FOLD) + b" "


def terms(text: str | None) -> list[str]:
    return [t.decode() for t in folded(text or "").split(b" ") if t]


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds ` word ` in folded text read as Latin-1; the value of a word is its place in the list."""
    found = ahocorasick.Automaton()
    for i, word in enumerate(words):
        found.add_word(f" {word} ".encode().decode("latin-1"), i)
    found.make_automaton()
    return found


def term_count(data: bytes) -> int:
    """Terms of folded text with repeats: the starts of runs that are no guard."""
    inside = np.frombuffer(data, np.uint8) != _GUARD
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """`item, term, weight`: the terms of every item and how often it holds them. Rows with the same id are
    one item. Written to the shared folder."""

    def run(batch):
        found = [(i, t) for i, text in enumerate(batch.column(1).to_pylist()) for t in terms(text)]
        rows = pa.array([i for i, _ in found], pa.int64())
        return pa.record_batch([batch.column(0).take(rows), pa.array([t for _, t in found], pa.string())], names=["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    split = rows.mapInArrow(common.per_batch(run), f"item {kind}, term string")
    return common.cut(split.groupBy("item", "term").agg(F.count("*").alias("weight")))


def item_blocks(asked: DataFrame, most: int = BLOCK_BYTES, seed: int = 0) -> Iterator[pa.Table]:
    """The rows of `item_terms` in blocks of whole items, each of at most `most` bytes or of one item. Blocks
    that come out too large are dealt again by another hash."""
    size = F.octet_length("term") + F.lit(16)
    found = asked.agg(F.coalesce(F.sum(size), F.lit(0)).alias("size"), F.min("item") != F.max("item"), F.count("*") > F.count("item"))
    bytes_, several, nulls = found.first()
    if bytes_ <= most or not (several or nulls):
        if bytes_:
            yield asked.toArrow()
        return
    parts = -(-bytes_ // most)
    dealt = asked.withColumn("_part", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(parts)))
    for part in range(parts):
        yield from item_blocks(dealt.filter(F.col("_part") == part).drop("_part"), most, seed + 1)


def counts(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n, term, tf`: per row of `docs` its number of terms, and the places in `words` of those that it
    holds with their counts. Whole texts; null is empty. Written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(sent.value)
        for batch in common.slices(batches):
            n, held, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                data = folded(text)
                n.append(term_count(data))
                found = np.fromiter((v for _, v in known.iter(data.decode("latin-1"))), np.int32)
                distinct, tf = np.unique(found, return_counts=True)
                held.append(distinct)
                tfs.append(tf)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tfs).astype(np.int64)))],
                names=["id", "n", "term", "tf"],
            )

    texts = common.keyed_texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    return common.cut(texts.mapInArrow(run, f"id {kind}, n long, term array<int>, tf array<long>"))


def best_of(rows: pa.Table, k: int) -> pa.Table:
    """The `k` best rows (`item, score, id`) of each item: highest score, then least id, a null id first."""
    order = pc.sort_indices(
        rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"
    )
    rows = rows.take(order)
    item = rows.column("item").to_numpy()
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    place = np.arange(len(item)) - np.repeat(start, np.diff(np.concatenate([start, [len(item)]])))
    return rows.filter(pa.array(place < k))


def scores(found: DataFrame, n_items: int, outputs: tuple[np.ndarray, ...], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """`item, id, score`: the `k` best documents per item and task of `counts`, items by number. `outputs` maps term
    i to `items[begin[i]:begin[i + 1]]`, with `times` the item holds it."""
    sent = found.sparkSession.sparkContext.broadcast((*outputs, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, items, times, weights = sent.value
        held: pa.Table | None = None
        least = np.ones(n_items, np.int64)  # a score below this cannot enter an item's list
        at_once = max(1, _TABLE // n_items)
        for batch in common.slices(batches, min(500, at_once)):
            size = batch.num_rows
            term, ends = common.lists(batch.column(2), np.int64)
            tf, _ = common.lists(batch.column(3), np.int64)
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            doc = np.repeat(np.arange(size), np.diff(ends))
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            fan = begin[term + 1] - begin[term]
            place = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan - begin[term], fan)
            table = np.zeros(size * n_items, np.int64)
            np.add.at(table, np.repeat(doc, fan) * n_items + items[place], np.repeat(part, fan) * times[place])
            table = table.reshape(size, n_items)
            row, item = np.nonzero(table >= least)
            if not len(row):
                continue
            new = pa.table({"item": item, "score": table[row, item], "id": batch.column(0).take(pa.array(row))})
            held = best_of(new if held is None else pa.concat_tables([held, new]), k)
            full = held.column("item").to_numpy()
            last = np.flatnonzero(np.concatenate([full[1:] != full[:-1], [True]]))
            enough = last[np.diff(np.concatenate([[-1], last])) == k]
            least[full[enough]] = np.maximum(1, held.column("score").to_numpy()[enough])
        if held is not None:
            yield from held.select(["item", "id", "score"]).combine_chunks().to_batches()

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"item long, id {kind}, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """`item, rank, id, score`: the `k` documents with the highest score above 0 per item.

    Equal scores are ordered by id, a null id first. Null and empty texts have no term and never match; an item
    without a term, and an empty table, give no rows. Rows of `items` with the same id are one item; rows
    of `docs` are documents of their own even where ids repeat. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    kind = asked.schema["item"].dataType.simpleString()
    out = None
    for block in item_blocks(asked, most):
        words, inverse = np.unique(block.column("term").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        coded = pc.dictionary_encode(block.column("item").combine_chunks(), null_encoding="encode")
        names = coded.dictionary
        order = np.argsort(inverse, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(words)))]).astype(np.int64)
        outputs = begin, coded.indices.to_numpy()[order].astype(np.int64), block.column("weight").to_numpy()[order]

        found = counts(docs, words.tolist(), id_col, text_col)
        n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), np.int64)  # one row per term of the block
        for term, documents in found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*")).collect():
            df[term] = documents
        weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
        part = scores(found, len(names), outputs, weights, n_docs, n_terms, k)
        labels = spark.createDataFrame(pa.table({"no": pa.array(range(len(names)), pa.int64()), "label": names}))
        top = scale.top_rows(part, ["item"], [F.desc("score"), F.asc("id")], k).withColumnRenamed("item", "no")
        top = top.join(F.broadcast(labels), "no").select(
            F.col("label").cast(kind).alias("item"), F.col("rank").cast("int").alias("rank"), "id", "score"
        )
        out = top if out is None else out.unionByName(top)
    if out is None:
        id_kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"item {kind}, rank int, id {id_kind}, score long")
    return out


def op13_scan(spark, sf_dir):
    found = ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})


def _sql_terms(text: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{common.UPPER}', '{common.LOWER}'), '{pattern}')"


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_sql_terms('text')} AS t FROM documents),
corpus AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_sql_terms('text')}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY 1),
norm AS (SELECT row, doc_id, 75 + (25::HUGEINT * len(t) * n_docs) // n_terms AS m FROM d, corpus),
s AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN norm USING (row) GROUP BY 1, 2, 3)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
