"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

CLASH = ", ".join(f"{c} string" for c in (
    "id", "block", "size", "data", "lang_pred", "score", "recipe", "chunks", "part", "at", "n", "ids", "digest", "tokens",
    "nodes", "node", "grp", "component", "base", "spans", "_base", "_text", "host", "path", "rule", "verdict", "label",
))


def documents(spark, rows):
    """`doc_id, text, lang, source, n_chars` of (doc_id, text, lang), with extra columns that clash."""
    extra = CLASH.split(", ")
    full = [(i, t, lang, None, None if t is None else len(t), *["x"] * len(extra)) for i, t, lang in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


WORDS = "the quick brown fox jumps over the lazy dog while seven bright owls watch from tall old trees near town".split()
LONG = " ".join(f"{w}{i % 977}" for i in range(20000) for w in ("alpha", "beta"))
ROWS = [
    (1, " ".join(WORDS * 3), "en"), (2, " ".join(WORDS * 3), "en"), (3, " ".join(WORDS * 3).upper(), "en"),
    (4, None, "en"), (5, "", None), (6, "   \n", "en"), (7, "word", "en"), (7, "word", "en"), (None, "word", None),
    (None, " ".join(WORDS * 3), "en"), (8, LONG, "en"), (9, LONG + " end", "de"), (10, "a" * 30000, "de"),
    (11, "12345 678", "de"), (12, "é日本😀 <|endoftext|> \x00  ", "fr"), (13, " ".join(WORDS * 3) + " extra", "en"),
]


def write(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
