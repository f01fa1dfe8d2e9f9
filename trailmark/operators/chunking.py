"""Topic-coherent chunks of page text.

A page stays on its row from text to chunks: sentences, windows, breakpoints, merges and splits are
array expressions, so chunking needs no shuffle and a long page costs only its own task. The one
Python step compares neighbouring windows with the embedder.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from trailmark.functions import text as T
from trailmark.functions.arrays import let
from trailmark.operators.embedding import Embedder

# A break after punctuation before a capital, or after a line break.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\S)"
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85      　" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
# Sentence, window and chunk sizes (tokens are whitespace words).
MIN_SENTENCE_CHARS = 11
WINDOW = 3
MAX_TOKENS = 512
WORDS_PER_TOKEN = 0.75
MIN_WORDS = 50
MIN_SIMILARITY = 0.5
OVERSIZE = 1.5


def split_sentences(text: Column) -> Column:
    """Sentences of more than 10 characters, trimmed, in order."""
    pieces = F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK)
    trimmed = F.transform(pieces, lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(trimmed, lambda s: F.length(s) >= MIN_SENTENCE_CHARS)


def sentences_or_words(text: Column, run: int = MIN_WORDS) -> Column:
    """The sentences; of a text that has only shorter ones, all its words in runs of `run`, so that none is lost."""
    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(run)))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(run)), " "))
        return F.coalesce(joined, F.array().cast("array<string>"))

    words = T.words(F.coalesce(text, F.lit("")))
    return let(split_sentences(text), lambda found: F.when(F.size(found) > 0, found).otherwise(let(words, runs)))


def text_blocks(text: str, limit: int | None = None) -> list[str]:
    """The text as pieces of at most `limit` characters, or as one without a limit.

    Pieces end behind a line break or sentence end wherever one lies in reach, and together are the text.
    """
    if limit is None or len(text) <= limit:
        return [text] if text else []
    breaks = [m.end() for m in re.finditer(r"\n|[.!?] ", text)]
    ends, last = [], 0
    while len(text) - last > limit:
        reach = bisect_right(breaks, last + limit)
        near = breaks[reach - 1] if reach else 0
        last = near if near > last else last + limit
        ends.append(last)
    return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])]


def model_splitter(
    load: Callable[[], Callable[[str], list[str]]], max_chars: int | None = None
) -> Callable[[Column], Column]:
    """A splitter backed by a language model: `load` runs once per worker, text -> sentences.

    The model gets whole texts; one that can't take them gets pieces of `max_chars`, and a sentence without
    a break in reach is then cut. Where the model fails the regular expression takes over.
    """
    @F.pandas_udf(st.ArrayType(st.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def sentences(text: str | None) -> list[str] | None:
            try:
                found = [s.strip() for block in text_blocks(text or "", max_chars) for s in model(block)]
            except Exception:
                return None
            return [s for s in found if len(s) >= MIN_SENTENCE_CHARS]

        for texts in batches:
            yield pd.Series([sentences(t) for t in texts])

    split = split.asNondeterministic()
    return lambda text: F.coalesce(split(text), split_sentences(text))


def windows(sentences: Column, size: int = WINDOW) -> Column:
    """Overlapping runs of `size` sentences; none when there are at most twice as many sentences.

    `sentences` must be a stored column, not an expression: it is read once per run.
    """
    starts = F.when(F.size(sentences) > 2 * size, F.sequence(F.lit(1), F.size(sentences) - (size - 1)))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(sentences, i, F.lit(size)), " "))
    return F.coalesce(joined, F.array().cast("array<string>"))


def break_threshold(similarities: Column, floor: float = MIN_SIMILARITY) -> Column:
    """The larger of `floor` and mean minus population standard deviation, to 9 digits."""
    def cut(sims: Column) -> Column:
        n = F.size(sims).cast("double")
        mean = F.aggregate(sims, F.lit(0.0), lambda a, x: a + x) / n

        def below(m: Column) -> Column:
            spread = F.aggregate(sims, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n
            return F.greatest(F.lit(floor), F.round(m - F.sqrt(spread), 9))

        return F.when(n > 0, let(mean, below))

    return let(similarities, cut)


def similarity_ends(n: Column, similarities: Column, threshold: Column, size: int = WINDOW) -> Column:
    """Per sentence, whether a segment ends after it; the last sentence always ends one."""
    def ends(known: Column) -> Column:
        def end(i: Column) -> Column:
            below = F.get(known["sims"], i - F.lit(size - 1)) < known["cut"]
            return (i == known["n"] - 1) | F.coalesce(below, F.lit(False))

        return F.transform(F.sequence(F.lit(0), known["n"] - 1), end)

    return let(F.struct(n.alias("n"), similarities.alias("sims"), threshold.alias("cut")), ends)


def fixed_ends(words: Column, max_words: int) -> Column:
    """Fallback without an embedder: a segment ends when it reaches `max_words` words."""
    start = F.struct(
        F.lit(0).cast("long").alias("w"), F.lit(0).alias("p"), F.array().cast("array<int>").alias("out")
    )

    def step(acc: Column, w: Column) -> Column:
        full = acc["w"] + w >= max_words
        return F.struct(
            F.when(full, F.lit(0)).otherwise(acc["w"] + w).cast("long").alias("w"),
            (acc["p"] + 1).alias("p"),
            F.when(full, F.concat(acc["out"], F.array(acc["p"]))).otherwise(acc["out"]).alias("out"),
        )

    def ends(w: Column) -> Column:
        return let(
            F.aggregate(w, start, step)["out"],
            lambda full: F.transform(
                F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == F.size(w) - 1) | F.array_contains(full, i)
            ),
        )

    return let(words, ends)


def merge_small(words: Column, ends: Column, min_words: int = MIN_WORDS) -> Column:
    """Segment end positions after merging forward until `min_words`; a short tail joins the last."""
    start = F.struct(
        F.lit(0).cast("long").alias("w"), F.lit(0).alias("p"), F.array().cast("array<int>").alias("out")
    )

    def step(acc: Column, m: Column) -> Column:
        total = acc["w"] + m["w"]
        closed = m["e"] & (total >= min_words)
        position = acc["p"] + 1
        return F.struct(
            F.when(closed, F.lit(0)).otherwise(total).cast("long").alias("w"),
            position.alias("p"),
            F.when(closed, F.concat(acc["out"], F.array(position))).otherwise(acc["out"]).alias("out"),
        )

    marks = F.zip_with(words, ends, lambda w, e: F.struct(w.alias("w"), e.alias("e")))

    def closed_at(folded: Column) -> Column:
        out, n = folded["out"], folded["p"]
        return F.when(F.size(out) == 0, F.array(n)).otherwise(
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(n))
        )

    return let(F.aggregate(marks, start, step), closed_at)


def split_oversized(words: Column, segment_ends: Column, max_words: int, factor: float = OVERSIZE) -> Column:
    """Piece end positions: segments above `factor * max_words` are cut greedily at `max_words`."""
    def step(acc: Column, w: Column) -> Column:
        cut = (acc["w"] + w > max_words) & (acc["w"] > 0)
        return F.struct(
            F.when(cut, w).otherwise(acc["w"] + w).cast("long").alias("w"),
            (acc["p"] + 1).cast("int").alias("p"),
            F.when(cut, F.concat(acc["out"], F.array(acc["p"]))).otherwise(acc["out"]).alias("out"),
        )

    def cuts(known: Column) -> Column:
        def pieces(end: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(known["ends"], i - 1))

            def greedy(inside: Column) -> Column:
                total = F.aggregate(inside, F.lit(0).cast("long"), lambda a, w: a + w)
                start = F.struct(
                    F.lit(0).cast("long").alias("w"), begin.cast("int").alias("p"),
                    F.array().cast("array<int>").alias("out"),
                )
                small = F.concat(F.aggregate(inside, start, step)["out"], F.array(end))
                return F.when(total > F.lit(factor * max_words), small).otherwise(F.array(end))

            return let(F.slice(known["words"], begin + 1, end - begin), greedy)

        return F.flatten(F.transform(known["ends"], pieces))

    return let(F.struct(words.alias("words"), segment_ends.alias("ends")), cuts)


def sentence_table(pages: DataFrame, key: str = "url", text_col: str = "content") -> DataFrame:
    """`key, idx, sentence, words` with one row per sentence."""
    rows = pages.select(key, F.posexplode(split_sentences(F.col(text_col))).alias("idx", "sentence"))
    return rows.withColumn("words", T.whitespace_words(F.col("sentence")))


def with_breaks(
    pages: DataFrame,
    embedder: Embedder,
    text_col: str = "content",
    max_tokens: int = MAX_TOKENS,
    splitter: Callable[[Column], Column] = split_sentences,
) -> DataFrame:
    """Adds `sentences, words, similarities, threshold, ends` to pages that hold a sentence.

    Pages that make one chunk are not embedded.
    """
    max_words = max(1, int(max_tokens * WORDS_PER_TOKEN))
    cut = (
        pages.withColumn("sentences", splitter(F.col(text_col)))
        .filter(F.size("sentences") > 0)
        .withColumn("words", F.transform("sentences", T.whitespace_words))
    )
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
    n = F.size("sentences")
    single = (total <= max_words) | (n <= WINDOW)
    compared = (
        cut.withColumn("is_single", single)
        .withColumn(
            "_windows",
            F.when(F.col("is_single"), F.array().cast("array<string>")).otherwise(windows(F.col("sentences"))),
        )
        .withColumn("similarities", embedder.adjacent_similarity(F.col("_windows")))
        .drop("_windows")
        .withColumn("threshold", break_threshold(F.col("similarities")))
    )
    by_topic = similarity_ends(n, F.col("similarities"), F.col("threshold"))
    return compared.withColumn(
        "ends",
        F.when(F.col("similarities").isNull(), fixed_ends(F.col("words"), max_words)).otherwise(by_topic),
    )


def chunk_pages(
    pages: DataFrame,
    embedder: Embedder,
    url_col: str = "url",
    title_col: str = "title",
    text_col: str = "content",
    max_tokens: int = MAX_TOKENS,
    min_words: int = MIN_WORDS,
    splitter: Callable[[Column], Column] = split_sentences,
) -> DataFrame:
    """`chunk_id, page_url, page_title, text, chunk_index, token_count, context_prefix`.

    Pieces are numbered before short ones are dropped, so indexes may have gaps. A page whose
    pieces are all short becomes one chunk.
    """
    max_words = max(1, int(max_tokens * WORDS_PER_TOKEN))
    source = pages.select(
        F.col(url_col).alias("page_url"), F.col(title_col).alias("page_title"), F.col(text_col).alias("_text")
    )
    cut = with_breaks(source, embedder, "_text", max_tokens, splitter)
    n = F.size("sentences")
    whole = F.array(n)
    segments = F.when(F.col("is_single"), whole).otherwise(merge_small(F.col("words"), F.col("ends"), min_words))
    staged = cut.select("page_url", "page_title", "sentences", "words", "is_single", segments.alias("segments"))
    stops = F.when(F.col("is_single"), whole).otherwise(split_oversized(F.col("words"), F.col("segments"), max_words))

    def piece(end: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("stops", i - 1))
        return F.struct(
            i.cast("int").alias("chunk_index"),
            begin.alias("begin"),
            end.alias("end"),
            F.aggregate(
                F.slice("words", begin + 1, end - begin), F.lit(0).cast("long"), lambda a, w: a + w
            ).alias("token_count"),
        )

    numbered = staged.withColumn("stops", stops).withColumn("pieces", F.transform("stops", piece))
    long_enough = F.filter("pieces", lambda p: p["token_count"] >= min_words)
    all_words = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)
    one = F.array(
        F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("begin"), n.alias("end"), all_words.alias("token_count"))
    )
    kept = F.when(F.size("pieces") == 1, F.col("pieces")).otherwise(
        F.when(F.size(long_enough) > 0, long_enough).otherwise(one)
    )
    texts = F.transform(
        kept,
        lambda p: F.struct(
            p["chunk_index"].alias("chunk_index"),
            F.array_join(F.slice("sentences", p["begin"] + 1, p["end"] - p["begin"]), " ").alias("text"),
            p["token_count"].alias("token_count"),
        ),
    )
    return (
        numbered.select("page_url", "page_title", F.explode(texts).alias("c"))
        .select(
            T.chunk_id(F.col("page_url"), F.col("c.chunk_index")).alias("chunk_id"),
            "page_url", "page_title", "c.text", "c.chunk_index", "c.token_count",
            T.context_prefix(F.col("page_title"), F.col("page_url")).alias("context_prefix"),
        )
    )
