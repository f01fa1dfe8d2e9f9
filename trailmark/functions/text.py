"""Text expressions: tokens, word counts, hashes, snippets, sanitising."""

from __future__ import annotations

import re

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Tag names that fence page-derived text in an assembled prompt.
RESERVED_TAGS = ("context", "entity_relationships", "page_content", "browsing_activity")


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical decomposition is one base letter plus marks."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) > 1 and parts[0].isascii():
            accented.append(letter)
            plain.append(parts[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without diacritics. Plain ASCII text skips the slower translation."""
    lowered = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(
        F.translate(lowered, ACCENTED, PLAIN)
    )


def terms(text: Column) -> Column:
    """Search terms in order: maximal runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive n-token phrases, joined by one blank."""
    if n == 1:
        return tokens
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")),
        F.array().cast("array<string>"),
    )


def whitespace_words(text: Column) -> Column:
    """Number of whitespace-separated words (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def content_words(text: Column) -> Column:
    """Number of whitespace-separated words holding a letter or digit.

    Anchored at word starts with a possessive prefix, so a long rule of dashes costs one scan.
    """
    pattern = r"(?U)(?<!\S)[^\s\p{L}\p{N}]*+[\p{L}\p{N}]"
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The whitespace-separated words themselves."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256, used for change detection."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(url: Column, index: Column) -> Column:
    """First 16 hex digits of MD5 over `url::chunk_index`."""
    return F.substring(F.md5(F.concat(url, F.lit("::chunk_"), index.cast("string"))), 1, 16)


def context_prefix(title: Column, url: Column) -> Column:
    """`[title] (url)`; empty without a title, no url part without a url."""
    has_title = F.coalesce(title, F.lit("")) != ""
    has_url = F.coalesce(url, F.lit("")) != ""
    bracketed = F.concat(F.lit("["), title, F.lit("]"))
    return F.when(
        has_title, F.when(has_url, F.concat(bracketed, F.lit(" ("), url, F.lit(")"))).otherwise(bracketed)
    ).otherwise(F.lit(""))


def embedding_text(prefix: Column, text: Column) -> Column:
    """The text an embedder sees for a stored chunk."""
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)


def snippet(text: Column, length: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def sanitize(text: Column) -> Column:
    """Defuse reserved tags so that page text cannot close the block it is quoted in."""
    pattern = r"(?iU)<\s*(/?)\s*(" + "|".join(RESERVED_TAGS) + r")\b"
    return F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "[$1$2")


# Model names (case ignored) and the prefix their queries need.
QUERY_PREFIXES = {
    r"bge.*-en|-en.*bge": "Represent this sentence for searching relevant passages: ",
}


def query_instruction(model: str) -> str:
    """Query-side prefix for embedders trained with one; documents never get it."""
    fitting = (prefix for names, prefix in QUERY_PREFIXES.items() if re.search(names, model or "", re.I))
    return next(fitting, "")
