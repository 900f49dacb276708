"""Queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import ballkmeans, hnsw, kdtree, licenses, minhash, mixing, packing, pieces, quality, resampling, substrings, tokencount, toxicity
from .common import table


def op1_best_fit_packing(spark, sf_dir):
    """Every document's token pieces with their sequence and offset."""
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op7_hnsw_neighbours(spark, sf_dir):
    """The five nearest vectors found for every fiftieth id."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op8_quality(spark, sf_dir):
    """Every document's quality score and prediction."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_kdtree_top_products(spark, sf_dir):
    """The five largest whole-number products for every fiftieth id."""
    return kdtree.top_products(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark, sf_dir):
    """How many words of every document the mix takes, with its source's size and target."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op2_toxicity(spark, sf_dir):
    """Every document's toxicity score and prediction."""
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark, sf_dir):
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    """What is left of every document without passages of earlier ones."""
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    """Every document's number of tokens, measured in flat token files."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark, sf_dir):
    """Every document's component of near copies."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "component")


def op11_importance_resampling(spark, sf_dir):
    """Every document's n-gram weight towards the benchmark texts, and the quarter drawn by it."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ball_kmeans(spark, sf_dir):
    """Every embedding's cluster after three rounds from 16 seeded centroids."""
    return ballkmeans.clusters(table(spark, sf_dir, "embeddings"))


def op13_piece_tokens(spark, sf_dir):
    """Digests of every document's SentencePiece ids and of the text they decode to."""
    return pieces.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_license_scan, op4_substring_dedup, op5_token_counts, op6_minhash_near_dedup, op7_hnsw_neighbours, op8_quality, op9_kdtree_top_products, op10_source_mixing, op11_importance_resampling, op12_ball_kmeans, op13_piece_tokens)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

ORACLE["op4_substring_dedup"] = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
late AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (h) WHERE f < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM late),
words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


ORACLE["op9_kdtree_top_products"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

#: The exact neighbours: the search is approximate, its recall on the test tables is 1, and a miss would show as a difference.
ORACLE["op7_hnsw_neighbours"] = """
WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT DISTINCT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) / (c.norm * q.norm) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

ORACLE["op11_importance_resampling"] = resampling.resampled_sql()
ORACLE["op12_ball_kmeans"] = ballkmeans.clusters_sql()
ORACLE["op3_license_scan"] = licenses.scan_sql()

#: Exact components: equal sets first, then pairs of sets that share a shingle, then the least doc_id reachable.
ORACLE["op6_minhash_near_dedup"] = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
k AS MATERIALIZED (SELECT min(doc_id) AS rep, len(g) AS n, g FROM s WHERE len(g) > 0 GROUP BY g),
x AS MATERIALIZED (SELECT rep, n, hash(u) AS h FROM (SELECT rep, n, unnest(g) AS u FROM k)),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rep, rep FROM k),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS rep, min(b) AS c FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN k ON s.g = k.g LEFT JOIN c ON c.rep = k.rep"""
