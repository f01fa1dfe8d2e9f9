"""A stored, positional keyword index.

A posting is `bucket, term, chunk_id, length, positions`: where one term stands in one chunk. Files hold it packed: a row
has a term's postings in a block of chunks as lists (PACKED), so that a shuffle and a sort move a row per term and block
and not one per term and chunk. `read` unfolds them. Rows are kept in
folders by the bucket of their term and sorted by term inside a file, so that a search reads the folders and
the stretches of files its terms are in, and no text. A hot term is many files: every bucket is
spread over sub-keys of the chunk. Folder LENGTHS holds one posting per chunk, with its length alone.

An index grows by segments. A chunk that is removed or written anew leaves a row in `removed`, which hides its
postings in all earlier segments until the index is written as one segment again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import text as T
from trailmark.operators import scale
from trailmark.session import cut_lineage

BUCKETS = 64
#: Files that the postings of one bucket are spread over.
SPREAD = 4
#: Bytes of packed rows that a task gathers before it sends them, a compressed block for each folder and file.
SENT_BYTES = 64_000_000
#: Tokens of the corpus for each task that looks for phrases.
TASK_TOKENS = 4_000_000
#: Pseudo bucket of the rows that hold the lengths of all chunks.
LENGTHS = -1
COLUMNS = ("bucket", "term", "chunk_id", "length", "positions")
PACKED = ("bucket", "term", "chunk_ids", "lengths", "positions")
#: Tokens of a block of chunks, whose postings are packed together. A block has at least one chunk.
BLOCK_TOKENS = 2_000_000


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _sorted_places(codes: np.ndarray) -> np.ndarray:
    """The places of `codes` in ascending order; equal ones keep their order."""
    keys = (codes.astype(np.int64) << 32) | np.arange(len(codes))
    keys.sort()
    return keys & 0xFFFFFFFF


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    """`term, chunk_ids, lengths, positions` of `chunk_id, tokens`: a row per term, after one with the lengths of all chunks."""
    offsets = batch.column(1).offsets.to_numpy()
    flat = batch.column(1).values.slice(offsets[0], offsets[-1] - offsets[0])
    n, sizes = batch.num_rows, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = _sorted_places(codes)
    codes, row = codes[order], row[order]
    posting = _starts(codes, row)
    term = _starts(codes[posting])
    owner = np.concatenate([np.arange(n), row[posting]])
    rows = np.concatenate([[0], n + term])
    places = _lists(np.concatenate([np.zeros(n, np.int64), posting]), pa.array(place[order].astype(np.int32)))
    return pa.record_batch(
        [pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary.take(pa.array(codes[posting][term]))]),
         _lists(rows, batch.column(0).take(pa.array(owner))),
         _lists(rows, pa.array(sizes[owner].astype(np.int32))), _lists(rows, places)],
        names=["term", "chunk_ids", "lengths", "positions"],
    )


def of_chunks(
    chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
    tokenizer: Callable[[Column], Column] = T.terms, buckets: int = BUCKETS,
) -> DataFrame:
    """The packed postings (PACKED) of a chunk table, made where the text is: nothing is shuffled. A null text is
    empty. Ids must be unique and not null."""
    tokens = chunks.select(
        F.col(id_col).alias("chunk_id"),
        F.coalesce(tokenizer(F.coalesce(F.col(text_col), F.lit(""))), F.array().cast("array<string>")).alias("tokens"),
    )
    kind = tokens.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BLOCK_TOKENS, "right")) - 1)
                yield _block(batch.slice(begin, end - begin))
                begin = end

    found = tokens.mapInArrow(run, f"term string, chunk_ids array<{kind}>, lengths array<int>, positions array<array<int>>")
    bucket = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise(bucket_of(F.col("term"), buckets))
    return found.withColumn("bucket", bucket).select(*PACKED)


def packed(rows: DataFrame) -> DataFrame:
    """PACKED of single postings (COLUMNS): what stands together is packed, nothing is shuffled."""
    kind = rows.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                batch = batch.sort_by("term")
                codes = batch.column(1).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                starts = _starts(codes)
                first = pa.array(starts)
                yield pa.record_batch(
                    [batch.column(0).take(first), batch.column(1).take(first),
                     *(_lists(starts, batch.column(i)) for i in (2, 3, 4))], names=list(PACKED),
                )

    whole = rows.select("bucket", "term", "chunk_id", F.col("length").cast("int").alias("length"), "positions")
    return whole.mapInArrow(run, f"bucket int, term string, chunk_ids array<{kind}>, lengths array<int>, positions array<array<int>>")


def unpacked(rows: DataFrame) -> DataFrame:
    """Single postings (COLUMNS, then what else `rows` has) of PACKED."""
    more = [c for c in rows.columns if c not in PACKED]
    lists = F.arrays_zip("chunk_ids", "lengths", "positions")
    single = rows.select("bucket", "term", *more, F.inline(lists).alias("chunk_id", "length", "positions"))
    return single.select("bucket", "term", "chunk_id", F.col("length").cast("long").alias("length"), "positions", *more)


def _sent(batches):
    """`bucket, salt, block` of rows that end with these two columns: what goes to one file, as compressed Arrow data."""
    def blocks(rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("bucket", "ascending"), ("salt", "ascending"), ("term", "ascending")]).combine_chunks()
        bucket, salt = (rows.column(c).to_numpy() for c in ("bucket", "salt"))
        starts = _starts(bucket, salt)
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        out = []
        for begin, end in zip(starts, np.append(starts[1:], rows.num_rows)):
            sink = pa.BufferOutputStream()
            own = rows.slice(begin, end - begin).drop_columns(["salt"])
            with pa.ipc.new_stream(sink, own.schema, options=options) as stream:
                stream.write_table(own)
            out.append(sink.getvalue().to_pybytes())
        yield pa.record_batch(
            [pa.array(bucket[starts], pa.int32()), pa.array(salt[starts], pa.int32()), pa.array(out, pa.binary())],
            names=["bucket", "salt", "block"],
        )

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > SENT_BYTES:
            yield from blocks(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from blocks(pa.Table.from_batches(held))


def _received(batches):
    for batch in batches:
        for block in batch.column(2):
            with pa.ipc.open_stream(block.as_buffer()) as stream:
                yield from stream


def write(postings: DataFrame, path: str, spread: int = SPREAD) -> None:
    """Writes postings (PACKED, or single ones) in folders by bucket, `spread` files each. They are shuffled as compressed
    blocks."""
    rows = (postings if "chunk_ids" in postings.columns else packed(postings)).select(*PACKED)
    salt = F.pmod(F.xxhash64(F.get("chunk_ids", F.lit(0))), F.lit(spread)).cast("int")
    sent = rows.withColumn("salt", salt).mapInArrow(_sent, "bucket int, salt int, block binary")
    dealt = sent.repartition("bucket", "salt").mapInArrow(_received, rows.schema).sortWithinPartitions("bucket", "term")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_schema(chunk_id: str = "string", more: str = "") -> str:
    """Columns of the files; `more` are those of folders above the buckets."""
    return f"term string, chunk_ids array<{chunk_id}>, lengths array<int>, positions array<array<int>>, {more}bucket int"


def read(spark, path: str, chunk_id: str = "string") -> DataFrame:
    return unpacked(spark.read.schema(stored_schema(chunk_id)).parquet(path))


def totals(postings: DataFrame) -> tuple[int, int]:
    """Chunks and their terms, from the rows of lengths."""
    row = postings.filter(F.col("bucket") == LENGTHS).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return row[0], row[1]


class Steps:
    """Phrases (to their terms) as steps: a state is the beginning of a phrase, and a term leads from one to the next."""

    def __init__(self, spelling: dict[str, list[str]]):
        self.phrases = list(spelling)
        self.terms = sorted({t for spelt in spelling.values() for t in spelt})
        number = {t: i for i, t in enumerate(self.terms)}
        begin = np.full(len(self.terms), -1, np.int64)
        step: dict[int, int] = {}
        ends = {}
        states = 0
        for place, spelt in enumerate(spelling.values()):
            state = -1
            for k, term in enumerate(spelt):
                t = number[term]
                after = int(begin[t]) if k == 0 else step.get(state * len(self.terms) + t, -1)
                if after < 0:
                    after, states = states, states + 1
                    if k == 0:
                        begin[t] = after
                    else:
                        step[state * len(self.terms) + t] = after
                state = after
            ends[state] = place
        self.begin = begin
        self.keys = np.array(sorted(step), np.int64)
        self.after = np.array([step[k] for k in self.keys], np.int64)
        self.end = np.full(states, -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def follow(self, place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and phrase of every occurrence. `place` (row times 2^32, and position in it) ascends, `number` is the term there."""
        at = np.arange(len(place))
        state = self.begin[number]
        rows, found = [], []
        k = 0
        while True:
            keep = state >= 0
            at, state = at[keep], state[keep]
            ended = self.end[state]
            hit = ended >= 0
            rows.append(place[at[hit]] >> 32)
            found.append(ended[hit])
            k += 1
            inside = at + k < len(place)
            at, state = at[inside], state[inside]
            follows = place[at + k] - place[at] == k
            at, state = at[follows], state[follows]
            if not len(at) or not len(self.keys):
                break
            wanted = state * len(self.terms) + number[at + k]
            step = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            state = np.where(self.keys[step] == wanted, self.after[step], -1)
        return np.concatenate(rows), np.concatenate(found)


@dataclass
class PostingsIndex:
    """An index to search: stored `postings` (COLUMNS and, with `removed`, `segment`), the number of live
    chunks and of their terms, and `removed` (`chunk_id, before`): postings of these chunks in segments before
    that number do not count."""

    postings: DataFrame
    n_chunks: int
    total_length: int
    buckets: int = BUCKETS
    removed: DataFrame | None = None

    def live(self, rows: DataFrame) -> DataFrame:
        if self.removed is None:
            return rows
        gone = self.removed.groupBy("chunk_id").agg(F.max("before").alias("before"))
        if scale.is_small(gone):
            gone = F.broadcast(gone)
        met = rows.join(gone, "chunk_id", "left")
        return met.filter(F.col("before").isNull() | (F.col("segment") >= F.col("before"))).drop("before")

    def of_terms(self, terms: DataFrame, fits: bool | None = None) -> DataFrame:
        """The live postings of `terms` (`term`). Only their buckets are read; the numbers of these, at most
        `buckets`, come to the driver first."""
        terms = terms.select("term").distinct()
        numbers = sorted(r[0] for r in terms.select(bucket_of(F.col("term"), self.buckets)).distinct().collect())
        read = self.postings.filter(F.col("bucket").isin(numbers))
        return self.live(scale.lookup_join(read, terms, "term", "left_semi", spread_by=F.col("chunk_id"), small_fits=fits))

    def counts(self, phrases: DataFrame, fits: bool | None = None) -> DataFrame:
        """`chunk_id, length, phrase, tf`: where the phrases (`phrase`, terms joined by blanks) occur.

        A phrase of one term is counted by its positions, a longer one by following them from term to term (`_runs`).
        """
        parts = phrases.select("phrase").distinct().withColumn("terms", F.split("phrase", " "))
        n = parts.agg(F.min(F.size("terms")), F.max(F.size("terms"))).first()
        shortest, longest = n[0] or 1, n[1] or 1
        out = []
        if shortest == 1:
            single = parts.filter(F.size("terms") == 1).select(F.col("phrase").alias("term"))
            out.append(self.of_terms(single, fits).select(
                "chunk_id", "length", F.col("term").alias("phrase"), F.size("positions").cast("long").alias("tf")
            ))
        if longest > 1:
            spelt = parts.filter(F.size("terms") > 1).select(
                "phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")
            )
            few = scale.is_small(spelt) if fits is None else fits
            out.append(self._runs(spelt) if few else self._joined_runs(spelt))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def _runs(self, spelt: DataFrame) -> DataFrame:
        """`counts` of the phrases `spelt` (`phrase, n, offset, term`), few enough to be held by every task.

        The positions of their terms are dealt by chunk, once, as numbers; a task then finds the phrases by steps from
        each position to the next, all positions at a time."""
        spelling: dict[str, list[str]] = {}
        for r in spelt.orderBy("phrase", "offset").collect():
            spelling.setdefault(r["phrase"], []).append(r["term"])
        steps = Steps(spelling)
        names = spelt.sparkSession.createDataFrame(list(enumerate(steps.terms)), "number int, term string")
        found = self.of_terms(names, True).join(F.broadcast(names), "term")
        own = found.select("chunk_id", F.col("length").cast("int").alias("length"), "number", "positions")
        # Not fewer than the session's, and so many that a task holds a bounded number of positions.
        least = int(spelt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = own.repartition(max(least, -(-self.total_length // TASK_TOKENS)), "chunk_id")
        kind = found.schema["chunk_id"].dataType.simpleString()

        def run(batches):
            rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
            if rows is None:
                return
            rows = rows.combine_chunks()
            ids = rows.column(0).combine_chunks().dictionary_encode()
            chunk = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.zeros(len(ids.dictionary), np.int64)
            lengths[chunk] = rows.column(1).to_numpy()
            lists = rows.column(3).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            place = (np.repeat(chunk, sizes) << 32) + lists.flatten().to_numpy()
            number = np.repeat(rows.column(2).to_numpy(), sizes)
            order = np.argsort(place)
            owner, phrase = steps.follow(place[order], number[order])
            key, tf = np.unique(owner * len(steps.phrases) + phrase, return_counts=True)
            owner, phrase = np.divmod(key, len(steps.phrases))
            texts = pa.array(steps.phrases, pa.string())
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.record_batch(
                    [ids.dictionary.take(pa.array(owner[part])), pa.array(lengths[owner[part]]),
                     texts.take(pa.array(phrase[part])), pa.array(tf[part].astype(np.int64))],
                    names=["chunk_id", "length", "phrase", "tf"],
                )

        return dealt.mapInArrow(run, f"chunk_id {kind}, length long, phrase string, tf long")

    def _joined_runs(self, spelt: DataFrame) -> DataFrame:
        """The same for more phrases than a task should hold. In the chunks with a phrase's rarest term, the
        positions of each of its terms are moved back by the term's place in the phrase, and what all terms have
        in common are its starts."""
        found = self.of_terms(spelt, False)
        # Only chunks with the rarest term of a phrase can hold it.
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        rarest = spelt.join(df, "term", "left").groupBy("phrase").agg(
            F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("offset"))).alias("term")
        )
        chunks = scale.lookup_join(found.select("term", "chunk_id"), rarest, "term", spread_by=F.col("chunk_id"), small_fits=False)
        wanted = cut_lineage(chunks.select("phrase", "chunk_id").join(spelt, "phrase"))
        met = scale.lookup_join(found, wanted, ["term", "chunk_id"])
        starts = F.transform("positions", lambda p: p - F.col("offset"))
        lists = met.select("phrase", "n", "chunk_id", "length", starts.alias("starts")).groupBy(
            "phrase", "n", "chunk_id", "length"
        ).agg(F.collect_list("starts").alias("lists")).filter(F.size("lists") == F.col("n"))
        shared = F.aggregate(
            F.slice("lists", F.lit(2), F.col("n")), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b)
        )
        return lists.select("chunk_id", "length", "phrase", F.size(shared).cast("long").alias("tf")).filter(F.col("tf") > 0)

    def term_statistics(self) -> DataFrame:
        """Document frequency and total occurrences per term. A hot term is summed file by file first."""
        rows = self.live(self.postings.filter(F.col("bucket") != LENGTHS))
        return rows.groupBy("term").agg(
            F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("occurrences")
        )
