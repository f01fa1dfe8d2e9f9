"""Queries over `embeddings` and `documents`: embedding, vector tables, nearest neighbours, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import chunking, embedding, scale
from trailmark.plans import search
from workload import base

EMBEDDER = embedding.hash_embedder(64)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label")
    )


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scale.spread(base.documents(spark, sf_dir), "chunk_id").select("chunk_id", EMBEDDER.vector(F.col("text")).alias("v"))
    cells = docs.select("chunk_id", F.posexplode("v").alias("pos", "x")).filter(F.col("x") != 0)
    return cells.select("chunk_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


def sql_hashed(name: str, source: str, key: str, text: str) -> str:
    """CTEs giving `{name}(key, pos, x)`: the non-zero cells of the hashed vectors of a text column."""
    return rf"""
{name}_tok AS (SELECT {key} AS key, unnest({base.sql_terms(text)}) AS t FROM {source}),
{name}_cell AS (SELECT key, (('0x' || substr(md5(t), 1, 8))::UBIGINT % 64)::BIGINT AS pos,
   sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
   FROM {name}_tok GROUP BY 1, 2),
{name}_len AS (SELECT key, sqrt(sum(v * v)) AS l FROM {name}_cell GROUP BY 1),
{name} AS (SELECT c.key, pos, CAST(v / l AS FLOAT)::DOUBLE AS x FROM {name}_cell c JOIN {name}_len USING (key) WHERE v <> 0)
"""


HASH_EMBED = f"""
WITH {sql_hashed('h', 'documents', 'doc_id', 'text')} SELECT key AS chunk_id, pos, round(x, 6) AS x FROM h
"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    return embedding.nearest(queries, vectors, 10).select("query_id", "chunk_id", "score", "rank")


VECTOR_TOPK = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id,
        round(greatest(0, list_cosine_similarity(q.e, d.e)), 6) AS score FROM v q, v d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10
"""


def vector_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).groupBy(F.size("vector").cast("long").alias("dim")).agg(F.count("*").alias("vectors"))


VECTOR_COUNT = "SELECT len(embedding)::BIGINT AS dim, count(*)::BIGINT AS vectors FROM embeddings GROUP BY 1"


def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = embedding.centroids(_vectors(spark, sf_dir), "label")
    return centres.select("label", F.posexplode("vector").alias("pos", "x")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


CENTROID_CTE = """
cells AS (SELECT label::VARCHAR AS label, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS r(i)),
means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY 1, 2),
lens AS (SELECT label, sqrt(sum(m * m)) AS l FROM means GROUP BY 1),
centre AS (SELECT label, pos, m / l AS x FROM means JOIN lens USING (label) WHERE l > 0)
"""
CENTROID = f"WITH {CENTROID_CTE} SELECT label, pos::BIGINT AS pos, round(x, 6) AS x FROM centre"


def prototype_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label centroids as prototypes: the lower five labels against the upper five."""
    vectors = _vectors(spark, sf_dir)
    centres = embedding.centroids(vectors, "label")
    junk, content = centres.filter("label < '5'"), centres.filter("label >= '5'")
    return embedding.prototype_gate(vectors, junk, content, 0.02).select("chunk_id", "junk_label", "junk_margin", "is_junk")


PROTOTYPE_GATE = f"""
WITH {CENTROID_CTE}, c AS (SELECT label, list(x ORDER BY pos) AS e FROM centre GROUP BY 1),
s AS (SELECT vec_id, label AS p, list_cosine_similarity(embedding::DOUBLE[], e) AS sim FROM (SELECT vec_id, embedding FROM embeddings), c),
j AS (SELECT vec_id, arg_max(p, sim) AS junk_label, max(sim) AS js FROM s WHERE p < '5' GROUP BY 1),
k AS (SELECT vec_id, max(sim) AS cs FROM s WHERE p >= '5' GROUP BY 1)
SELECT vec_id AS chunk_id, junk_label, round(js - cs, 6) AS junk_margin, round(js - cs, 6) > 0.02 AS is_junk FROM j JOIN k USING (vec_id)
"""


def _chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring vectors form a page; seven sites share the pages."""
    page = F.floor(F.col("vec_id") / 4)
    return base.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("https://site"), (page % 7).cast("string"), F.lit(".example.com/"), page.cast("string")).alias("page_url"),
    )


def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk_pages = _chunk_pages(spark, sf_dir)
    anchors = chunk_pages.select(F.col("page_url").alias("url"))
    return search.related_pages(anchors, chunk_pages, _vectors(spark, sf_dir), floor=0.3)


RELATED_PAGES = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
  'https://site' || ((vec_id // 4) % 7) || '.example.com/' || (vec_id // 4) AS page_url FROM embeddings),
cells AS (SELECT page_url, i AS pos, avg(e[i]) AS m FROM v, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2),
c AS (SELECT page_url AS url, list(m ORDER BY pos) AS ce FROM cells GROUP BY 1),
s AS (SELECT url, vec_id AS chunk_id, page_url, round(greatest(0, list_cosine_similarity(ce, e)), 6) AS sim FROM c, v),
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY sim DESC, chunk_id) AS b FROM s WHERE page_url <> url
      AND regexp_extract(page_url, '//([^/]*)', 1) <> regexp_extract(url, '//([^/]*)', 1))
SELECT url, page_url, chunk_id, sim AS similarity FROM o WHERE b = 1 AND sim >= 0.3
"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("chunk_id", "vector", F.concat(F.lit("model-"), "label").alias("fingerprint"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a positive first component arrive again under a new fingerprint, plus shifted ids."""
    current = _tagged(spark, sf_dir)
    again = current.filter(F.col("vector")[0] > 0).withColumn("fingerprint", F.lit("new"))
    added = again.withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    return embedding.upsert_vectors(current, again.unionByName(added), 64).select(
        "chunk_id", "fingerprint", F.round(F.col("vector")[0].cast("double"), 6).alias("x0")
    )


VECTOR_UPSERT = """
SELECT vec_id AS chunk_id, CASE WHEN embedding[1] > 0 THEN 'new' ELSE 'model-' || label END AS fingerprint,
  round(embedding[1]::DOUBLE, 6) AS x0 FROM embeddings
UNION ALL SELECT vec_id + 1000000, 'new', round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE embedding[1] > 0
"""


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids lost when the documents with a low character count are dropped from the chunk set."""
    old = base.documents(spark, sf_dir)
    return embedding.orphans(old, old.filter(F.length("text") >= 500))


ORPHAN_VECTORS = "SELECT doc_id AS chunk_id FROM documents WHERE length(text) < 500"


def stale_reembed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of English documents are current, the others carry an old fingerprint and are made again."""
    docs = base.documents(spark, sf_dir)
    lang = base.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    stored = embedding.embed_chunks(docs, EMBEDDER).join(lang, "chunk_id").select(
        "chunk_id", "vector", F.when(F.col("lang") == "en", F.col("fingerprint")).otherwise(F.lit("old")).alias("fingerprint")
    )
    return embedding.reembed(docs, stored, EMBEDDER).select(
        "chunk_id", "fingerprint", F.size("vector").cast("long").alias("dim")
    )


STALE_REEMBED = "SELECT doc_id AS chunk_id, 'hash64' AS fingerprint, 64::BIGINT AS dim FROM documents"


# ---- chunking -------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.spread(base.documents(spark, sf_dir), "chunk_id").select(
        F.col("page_url").alias("url"), F.col("page_title").alias("title"), F.col("text").alias("content"), "chunk_id"
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_table(_pages(spark, sf_dir), "chunk_id").select(
        "chunk_id", F.col("idx").cast("long").alias("idx"), "sentence", "words"
    )


# Break positions are marked with a control character, then split: this engine has no look-behind.
SENTENCE_CTE = r"""
marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(31) || '\2', 'g'),
             '\n\s*', chr(31), 'g') AS t FROM documents),
pieces AS (SELECT doc_id, unnest(string_split(t, chr(31))) AS p, unnest(range(0, len(string_split(t, chr(31))))) AS o FROM marked),
kept AS (SELECT doc_id, o, regexp_replace(p, '^\s+|\s+$', '', 'g') AS sentence FROM pieces),
sent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS idx, sentence,
           len(regexp_extract_all(sentence, '[^\s]+'))::BIGINT AS words
         FROM kept WHERE length(sentence) > 10)
"""
SENTENCES = f"WITH {SENTENCE_CTE} SELECT doc_id AS chunk_id, idx, sentence, words FROM sent"


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _pages(spark, sf_dir).select("chunk_id", chunking.split_sentences(F.col("content")).alias("s"))
    rows = split.select("chunk_id", F.posexplode(chunking.windows(F.col("s"))).alias("idx", "window_text"))
    return rows.select("chunk_id", F.col("idx").cast("long").alias("idx"), F.md5("window_text").alias("window_md5"))


WINDOW_CTE = rf"""
{SENTENCE_CTE},
totals AS (SELECT doc_id, count(*) AS n, sum(words) AS w FROM sent GROUP BY 1),
win AS (SELECT doc_id, idx, string_agg(sentence, ' ' ORDER BY idx) OVER f AS window_text
        FROM sent JOIN totals USING (doc_id) WHERE n > 6
        WINDOW f AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
wins AS (SELECT doc_id, idx, window_text, n, w FROM win JOIN totals USING (doc_id) WHERE idx <= n - 3)
"""
WINDOWS = f"""
WITH {WINDOW_CTE.replace("string_agg(sentence, ' ' ORDER BY idx) OVER f", "string_agg(sentence, ' ') OVER f")}
SELECT doc_id AS chunk_id, idx, md5(window_text) AS window_md5 FROM wins
"""
WINDOW_CTE = WINDOW_CTE.replace("string_agg(sentence, ' ' ORDER BY idx) OVER f", "string_agg(sentence, ' ') OVER f")


def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of neighbouring windows and the adaptive cut, for pages that need more than one chunk."""
    cut = chunking.with_breaks(_pages(spark, sf_dir), EMBEDDER).filter(~F.col("is_single"))
    rows = cut.select("chunk_id", "threshold", "ends", F.posexplode("similarities").alias("idx", "similarity"))
    return rows.select(
        "chunk_id", F.col("idx").cast("long").alias("idx"), F.round("similarity", 6).alias("similarity"),
        F.round("threshold", 6).alias("threshold"), F.get("ends", F.col("idx") + 2).alias("is_break"),
    )


SIMILARITY_CTE = rf"""
{WINDOW_CTE},
multi AS (SELECT doc_id || '/' || idx AS wkey, doc_id, idx, window_text FROM wins WHERE w > 384 AND n > 3),
{sql_hashed('hw', 'multi', 'wkey', 'window_text')},
hlen AS (SELECT key, sqrt(sum(x * x)) AS l FROM hw GROUP BY 1),
pairs AS (SELECT a.doc_id, a.idx, a.wkey AS k1, b.wkey AS k2 FROM multi a JOIN multi b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1),
dots AS (SELECT k1, k2, sum(x.x * y.x) AS d FROM pairs JOIN hw x ON x.key = k1 JOIN hw y ON y.key = k2 AND y.pos = x.pos GROUP BY 1, 2),
sims AS (SELECT p.doc_id, p.idx, round(coalesce(d / (l1.l * l2.l), 0), 9) AS similarity
         FROM pairs p LEFT JOIN dots USING (k1, k2) LEFT JOIN hlen l1 ON l1.key = k1 LEFT JOIN hlen l2 ON l2.key = k2),
thr AS (SELECT doc_id, greatest(0.5, round(avg(similarity) - stddev_pop(similarity), 9)) AS threshold FROM sims GROUP BY 1)
"""
BREAKPOINTS = f"""
WITH {SIMILARITY_CTE}
SELECT doc_id AS chunk_id, idx, round(similarity, 6) AS similarity, round(threshold, 6) AS threshold,
  similarity < threshold AS is_break FROM sims JOIN thr USING (doc_id)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_pages(_pages(spark, sf_dir), EMBEDDER).select(
        "chunk_id", "page_url", F.col("chunk_index").cast("long").alias("chunk_index"), "token_count",
        F.md5("text").alias("text_md5"), "context_prefix",
    )


# Merging and splitting are folds over the sentences of a document: two recursive queries.
CHUNK_CTE = rf"""
{SIMILARITY_CTE},
brk AS (SELECT s.doc_id, s.idx, s.sentence, s.words, t.n, t.w AS total, t.w <= 384 OR t.n <= 3 AS single,
          s.idx = t.n - 1 OR coalesce(m.similarity < h.threshold, false) AS is_end
        FROM sent s JOIN totals t USING (doc_id)
        LEFT JOIN sims m ON m.doc_id = s.doc_id AND m.idx = s.idx - 2 LEFT JOIN thr h ON h.doc_id = s.doc_id),
merge AS MATERIALIZED (SELECT * FROM brk WHERE NOT single),
RECURSION_ONE,
seg AS (SELECT doc_id, idx, least(coalesce(sum(closed::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
          greatest(sum(closed::INT) OVER (PARTITION BY doc_id) - 1, 0)) AS seg FROM fold1),
segw AS MATERIALIZED (SELECT m.doc_id, m.idx, m.words, g.seg, sum(m.words) OVER (PARTITION BY m.doc_id, g.seg) > 576 AS big,
           row_number() OVER (PARTITION BY m.doc_id, g.seg ORDER BY m.idx) = 1 AS starts
         FROM merge m JOIN seg g ON g.doc_id = m.doc_id AND g.idx = m.idx),
RECURSION_TWO,
numbered AS (SELECT doc_id, idx, sum(new_piece::INT) OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS piece FROM fold2),
piece AS (SELECT b.doc_id, coalesce(p.piece, 0) AS chunk_index, string_agg(b.sentence, ' ' ORDER BY b.idx) AS text, sum(b.words) AS tokens
          FROM brk b LEFT JOIN numbered p ON p.doc_id = b.doc_id AND p.idx = b.idx GROUP BY 1, 2),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS pieces, count(*) FILTER (tokens >= 50) OVER (PARTITION BY doc_id) AS longs FROM piece),
whole AS (SELECT doc_id, 0 AS chunk_index, string_agg(sentence, ' ' ORDER BY idx) AS text, sum(words) AS tokens FROM brk GROUP BY 1),
chosen AS (SELECT doc_id, chunk_index, text, tokens FROM counted WHERE pieces = 1 OR tokens >= 50
           UNION ALL SELECT w.* FROM whole w WHERE doc_id IN (SELECT doc_id FROM counted WHERE pieces > 1 AND longs = 0)),
named AS (SELECT c.*, 'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id AS url, 'Document ' || d.doc_id AS title
          FROM chosen c JOIN documents d USING (doc_id))
"""
RECURSION_ONE = """fold1 AS (
  SELECT doc_id, idx, words AS w, is_end AND words >= 50 AS closed FROM merge WHERE idx = 0
  UNION ALL
  SELECT m.doc_id, m.idx, CASE WHEN f.closed THEN 0 ELSE f.w END + m.words,
    m.is_end AND CASE WHEN f.closed THEN 0 ELSE f.w END + m.words >= 50
  FROM fold1 f JOIN merge m ON m.doc_id = f.doc_id AND m.idx = f.idx + 1)"""
RECURSION_TWO = """fold2 AS (
  SELECT doc_id, idx, words AS w, true AS new_piece FROM segw WHERE idx = 0
  UNION ALL
  SELECT m.doc_id, m.idx,
    CASE WHEN m.starts OR (m.big AND f.w + m.words > 384) THEN m.words ELSE f.w + m.words END,
    m.starts OR (m.big AND f.w + m.words > 384)
  FROM fold2 f JOIN segw m ON m.doc_id = f.doc_id AND m.idx = f.idx + 1)"""
CHUNK_CTE = CHUNK_CTE.replace("RECURSION_ONE", RECURSION_ONE).replace("RECURSION_TWO", RECURSION_TWO)
CHUNKS = f"""
WITH RECURSIVE {CHUNK_CTE}
SELECT left(md5(url || '::chunk_' || chunk_index), 16) AS chunk_id, url AS page_url, chunk_index::BIGINT AS chunk_index,
  tokens::BIGINT AS token_count, md5(text) AS text_md5, '[' || title || '] (' || url || ')' AS context_prefix FROM named
"""


def merge_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback without an embedder: fixed cuts, merge, split, on every document."""
    cut = _pages(spark, sf_dir).withColumn("sentences", chunking.split_sentences(F.col("content"))).filter(F.size("sentences") > 0)
    sized = cut.withColumn("words", F.transform("sentences", lambda s: F.size(F.split(s, r"\s+")).cast("long")))
    ends = sized.withColumn("ends", chunking.fixed_ends(F.col("words"), 384))
    merged = ends.withColumn("segments", chunking.merge_small(F.col("words"), F.col("ends")))
    return merged.select(
        "chunk_id", F.array_join(F.col("segments").cast("array<string>"), ",").alias("segment_ends"),
        F.array_join(chunking.split_oversized(F.col("words"), F.col("segments"), 100).cast("array<string>"), ",").alias("piece_ends"),
    )


MERGE_AND_SPLIT = f"""
WITH RECURSIVE {SENTENCE_CTE},
row0 AS MATERIALIZED (SELECT doc_id, idx, words, count(*) OVER (PARTITION BY doc_id) AS n FROM sent),
fold0 AS (
  SELECT doc_id, idx, words AS w, words >= 384 AS full_up FROM row0 WHERE idx = 0
  UNION ALL
  SELECT m.doc_id, m.idx, CASE WHEN f.full_up THEN 0 ELSE f.w END + m.words,
    CASE WHEN f.full_up THEN 0 ELSE f.w END + m.words >= 384
  FROM fold0 f JOIN row0 m ON m.doc_id = f.doc_id AND m.idx = f.idx + 1),
merge AS MATERIALIZED (SELECT r.doc_id, r.idx, r.words, full_up OR r.idx = r.n - 1 AS is_end FROM row0 r JOIN fold0 USING (doc_id, idx)),
{RECURSION_ONE},
seg AS (SELECT doc_id, idx, least(coalesce(sum(closed::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
          greatest(sum(closed::INT) OVER (PARTITION BY doc_id) - 1, 0)) AS seg FROM fold1),
segw AS MATERIALIZED (SELECT m.doc_id, m.idx, m.words, g.seg, sum(m.words) OVER (PARTITION BY m.doc_id, g.seg) > 150 AS big,
           row_number() OVER (PARTITION BY m.doc_id, g.seg ORDER BY m.idx) = 1 AS starts
         FROM merge m JOIN seg g ON g.doc_id = m.doc_id AND g.idx = m.idx),
{RECURSION_TWO.replace("384", "100")},
piece AS (SELECT doc_id, idx, sum(new_piece::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS piece FROM fold2),
ends AS (SELECT doc_id, 0 AS kind, max(idx) + 1 AS e FROM seg GROUP BY doc_id, seg
         UNION ALL SELECT doc_id, 1, max(idx) + 1 FROM piece GROUP BY doc_id, piece)
SELECT doc_id AS chunk_id, string_agg(e::VARCHAR, ',' ORDER BY e) FILTER (kind = 0) AS segment_ends,
  string_agg(e::VARCHAR, ',' ORDER BY e) FILTER (kind = 1) AS piece_ends FROM ends GROUP BY 1
"""

QUERIES = {
    "hash_embed": (hash_embed, HASH_EMBED),
    "vector_topk": (vector_topk, VECTOR_TOPK),
    "vector_count": (vector_count, VECTOR_COUNT),
    "centroid": (centroid, CENTROID),
    "prototype_gate": (prototype_gate, PROTOTYPE_GATE),
    "related_pages": (related_pages, RELATED_PAGES),
    "vector_upsert": (vector_upsert, VECTOR_UPSERT),
    "orphan_vectors": (orphan_vectors, ORPHAN_VECTORS),
    "stale_reembed": (stale_reembed, STALE_REEMBED),
    "sentences": (sentences, SENTENCES),
    "sentence_windows": (sentence_windows, WINDOWS),
    "breakpoints": (breakpoints, BREAKPOINTS),
    "chunks": (chunks, CHUNKS),
    "merge_and_split": (merge_and_split, MERGE_AND_SPLIT),
}
