"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, word ends marked) in
falling order. A text is compared with every language's profile by the out-of-place distance: the sum, over
the text's own profile, of how far each n-gram's rank is from its rank there; a missing n-gram
costs the profile length. The nearest profile names the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common
from trailmark.operators import scale

PROFILE_SIZE = 400
#: More languages than this are an error: the profiles are sent to every task.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: A document is rejected as unidentified below this score.
MIN_SCORE = 0.2

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARK = ord("_")
_BITS = 21
#: n-grams that a task holds before it hands its counts on.
_HELD = 1_000_000


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as sorted codes of 21 bits a character, and their counts.

    Empty for a text without a letter.
    """
    marked = "_" + _NOT_LETTERS.sub("_", (text or "").lower()).strip("_") + "_"
    if not any(c.isalpha() for c in set(marked)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    grams = np.concatenate([c[c != _MARK], two, three[c[1:-1] != _MARK]])
    return np.unique(grams, return_counts=True)


def _ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent, ties by code."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows():
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.record_batch(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    for batch in common.slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            grams, counts = gram_counts(text)
            if len(grams):
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
            if size > _HELD:
                held = {k: [merged(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _HELD // 2:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


def profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """`lang, gram, rank`: the `size` most frequent n-grams of each language over all of `labelled`
    (`lang, text`). Rows with a null language or text, or without a letter, teach nothing.

    Every task sums its rows first; the final ranking reads at most `size` rows per task and language.
    """
    counted = (
        labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
        .mapInArrow(common.releasing(_count_languages), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    return scale.top_rows(counted, ["lang"], [F.desc("n"), F.asc("gram")], size).select("lang", "gram", "rank")


def identify(docs: DataFrame, learned: DataFrame, size: int = PROFILE_SIZE, text_col: str = "text") -> DataFrame:
    """All columns of `docs` but of the names `lang_pred, score`, and these two.

    `score` is 1 less the out-of-place distance as a share of the largest one. A null text, or one
    without a letter, is `und` with score 0; so is every text if nothing was learned. Of languages
    at the same distance the first by name wins. Repeated rows stay repeated.
    """
    rows = learned.orderBy("lang", "rank").limit(MAX_LANGUAGES * size + 1).collect()
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by_lang: dict[str, list[int]] = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row["gram"])
    langs = sorted(by_lang)
    known = np.unique(np.array([g for v in by_lang.values() for g in v], np.int64))
    # ranks[l, g]: rank of known n-gram g in language l, -1 where it is missing.
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(text):
        grams, counts = gram_counts(text)
        if not len(grams) or not langs:
            return UNKNOWN, 0.0
        own = _ranked(grams, counts, size)
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        there = ranks[:, at]
        apart = np.where(there < 0, size, np.minimum(np.abs(there - np.arange(len(own))), size)).sum(axis=1)
        best = int(apart.argmin())
        return langs[best], 1 - float(apart[best]) / (size * len(own))

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    sent = docs.select(*kept)
    if text_col not in kept:
        sent = sent.withColumn(common.unused("_text", kept), F.col(text_col))
    at = kept.index(text_col) if text_col in kept else len(kept)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(text) for text in batch.column(at).to_pylist()]
        return pa.record_batch(
            [*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=[*kept, "lang_pred", "score"],
        )

    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return sent.mapInArrow(common.per_batch(run), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> DataFrame:
    """Profiles of the documents that are not held out; a null id is never learned from."""
    taught = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    return common.cut(profiles(taught.select("lang", "text")))


def op10_language(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(spark, docs, sf_dir):
    """Pipeline stage: documents whose language is known with a score of MIN_SCORE or more.

    A null text, or one without a letter, has no language and goes. Rows that repeat are judged alike, a null
    id as any other; all columns are kept, whatever their names.
    """
    # Numbered names cannot clash with the new columns, and the text travels once.
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = identify(docs.toDF(*names), learn(docs), text_col=names[docs.columns.index("text")])
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return out.filter(good).select(*names).toDF(*docs.columns)
