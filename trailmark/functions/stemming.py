"""English suffix stripping for the keyword index (M. F. Porter, "An algorithm for suffix stripping", 1980).

The stemmer is a tokenizer plug-in: `index_chunks(..., tokenizer=stemmed_terms)` and
`query_phrases(..., tokenizer=stemmed_terms)` must be used together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as st

from trailmark.functions import text as T

# Suffix pairs of the published steps 2 and 3, and the suffixes of step 4.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
)

_ASCII_WORD = re.compile(r"[a-z]{3,64}")
_MAX_CACHED = 200_000


def _shape(word: str) -> str:
    """Vowels as v, consonants as c; y is a vowel after a consonant."""
    shape = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    return _shape(stem).count("vc")


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace_longest(word: str, pairs) -> str:
    found = max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    if found:
        stem = word[: len(word) - len(found[0])]
        if _measure(stem) > 0:
            return stem + found[1]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words that are not 3 to 64 ASCII letters stay as they are."""
    if not _ASCII_WORD.fullmatch(word):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past tense and -ing
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-2:-1] == word[-1:] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(_replace_longest(word, STEP_2), STEP_3)
    # 4: only the longest suffix is tried
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix:
        base = word[: len(word) - len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    # 5
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _ends_cvc(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(st.ArrayType(st.StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}

    def look_up(word: str) -> str:
        if word not in known:
            if len(known) > _MAX_CACHED:
                known.clear()
            known[word] = stem(word)
        return known[word]

    for rows in batches:
        yield pd.Series([[look_up(w) for w in row] if row is not None else None for row in rows])


def stemmed_terms(text: Column) -> Column:
    """Search terms reduced to their stems. Each worker stems a distinct term once."""
    return _stems.asNondeterministic()(T.terms(text))
