"""Queries of the scoring models, their fusions and the title search.

Query 1 has one seed, query 2 has two. Lists are ranked by score to nine places, then id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import text as X
from ..functions import udf as U
from ..operators import fusion
from ..operators import popularity as pop
from ..operators import ranking as R
from ..operators import search as S
from ..operators import similarity as M
from ..operators.catalog import first_of
from ..sources.tables import table
from .cleaning import INTER_SQL, interactions, title_sql
from .profiling_queries import DIGEST_SQL
from .registry import query

c, lit = F.col, F.lit
SEEDS, QUERY_IDS, MIN_READERS = [(1, 3), (2, 7), (2, 12)], [1, 2], 5
SEEDS_SQL = "seeds AS (SELECT * FROM (VALUES (1, 3), (2, 7), (2, 12)) t(query_id, item_id))"
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def seeds(spark):
    return spark.createDataFrame(SEEDS, "query_id int, item_id long")


def documents(spark, d):
    return table(spark, d, "documents").select(c("doc_id").alias("item_id"), "text", "source", "lang", "n_chars")


def parts(spark, d):
    df = table(spark, d, "part")
    text = X.model_text(c("p_name"), F.array("p_type", "p_brand"), F.lit(None).cast("string"))
    return df.select(c("p_partkey").alias("item_id"), c("p_name").alias("title"), c("p_type").alias("author"), text.alias("text"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(c("vec_id").alias("item_id"), c("embedding").alias("vector"), "label")


def tfidf_sql(source: str, p: str = "t") -> str:
    """CTEs p_tf, p_vocab and p (item_id, term, weight) over source (item_id, text)."""
    words = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[\p{L}\p{Nl}\p{No}]{2,}'))"
    return f"""{p}_tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({words}) AS term FROM {source}) WHERE term NOT IN ({STOP_SQL}) GROUP BY item_id, term),
{p}_vocab AS (SELECT term, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM {p}_tf, (SELECT count(*) AS n FROM {source}) GROUP BY term, n HAVING count(*) BETWEEN 2 AND 0.5 * n),
{p} AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM (SELECT item_id, term, (1 + ln(tf)) * idf AS x FROM {p}_tf JOIN {p}_vocab USING (term)))"""


def similar_sql(postings: str, p: str, seeds: str = "seeds") -> str:
    return f"""{p}_prof AS (SELECT query_id, term, sum(weight) AS w FROM {seeds} JOIN {postings} USING (item_id) GROUP BY query_id, term),
{p} AS (SELECT query_id, b.item_id, round(sum(w * weight), 9) AS score FROM {p}_prof JOIN {postings} b USING (term) GROUP BY query_id, b.item_id)"""


def ranked_sql(scores: str, p: str) -> str:
    return f"{p} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM {scores})"


def top_sql(scores: str, k: int = 10) -> str:
    return f"{ranked_sql(f'(SELECT * FROM {scores} ANTI JOIN seeds USING (query_id, item_id))', 'top')} SELECT query_id, item_id, rank, round(score, 4) AS score FROM top WHERE rank <= {k}"


def completed_sql(scores: str, items: str, p: str) -> str:
    return f"{p} AS (SELECT q.query_id, i.item_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM seeds) q CROSS JOIN {items} i LEFT JOIN {scores} s ON s.query_id = q.query_id AND s.item_id = i.item_id)"


DOCS_SQL = "d AS (SELECT doc_id AS item_id, text FROM documents)"
BOTH_SQL = "d AS (SELECT doc_id AS item_id, text FROM documents), v AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
DENSE_SQL = "dense AS (SELECT query_id, v.item_id, round(sum(list_dot_product(s.x, v.x)), 9) AS score FROM seeds JOIN v s USING (item_id) CROSS JOIN v GROUP BY query_id, v.item_id)"
CF_SQL = "cw AS (SELECT item_id, user_id AS term, 1 / sqrt(n_readers) AS weight FROM inter JOIN readers USING (item_id))"
PARTS_SQL = "d AS (SELECT p_partkey AS item_id, p_name || '. ' || p_type || ', ' || p_brand || '. ' AS text FROM part)"


def listed(scores, spark, k=10):
    """The contract of every list: seeds out, k best, score to four places."""
    return R.top_k(R.without_seeds(scores, seeds(spark)), k).select("query_id", "item_id", "rank", F.round("score", 4).alias("score"))


def six():
    """Scores to six places, through decimals: both sides round the same nine digits."""
    return F.round(c("score").cast("decimal(18,9)"), 6).cast("double")


# --- postings -------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS_SQL}, {tfidf_sql('d')} SELECT term, df, round(idf, 6) AS idf FROM t_vocab")
def tfidf_vocab(spark, d):
    return M.vocabulary(documents(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOCS_SQL}, {tfidf_sql('d')} SELECT item_id, term, round(weight, 6) AS weight FROM t")
def tfidf_weights(spark, d):
    return M.tfidf_weights(documents(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {DOCS_SQL}, {SEEDS_SQL}, {tfidf_sql('d')}, {similar_sql('t', 's')} SELECT query_id, term, round(w, 6) AS weight FROM s_prof")
def multi_seed_profile(spark, d):
    return M.profiles(seeds(spark), M.tfidf(documents(spark, d), of=seeds(spark))).withColumn("weight", F.round("weight", 6))


@query(f"WITH {DOCS_SQL}, {SEEDS_SQL}, {tfidf_sql('d')}, {similar_sql('t', 's')} SELECT query_id, item_id, CAST(round(CAST(score AS DECIMAL(18, 9)), 6) AS DOUBLE) AS score FROM s")
def tfidf_similar(spark, d):
    return R.rounded(M.similar(seeds(spark), M.tfidf(documents(spark, d)))).withColumn("score", six())


@query(f"WITH {DOCS_SQL}, {SEEDS_SQL}, {tfidf_sql('d')}, {similar_sql('t', 's')}, {top_sql('s')}")
def tfidf_recommend(spark, d):
    return listed(M.best_similar(seeds(spark), M.tfidf(documents(spark, d)), 10), spark)


@query(f"WITH {DOCS_SQL}, {tfidf_sql('d')}, e AS (SELECT a.term, round(a.weight * b.weight, 9) AS score FROM t a JOIN t b USING (term) WHERE a.item_id = 7 AND b.item_id = 12 ORDER BY 2 DESC, 1 LIMIT 10) SELECT term, round(score, 3) AS score FROM e")
def explain_match(spark, d):
    return M.shared_terms(7, 12, M.tfidf(documents(spark, d), of=spark.createDataFrame([(7,), (12,)], "item_id long")))


@query(f"WITH {INTER_SQL}, {CF_SQL} SELECT item_id, term, round(weight, 6) AS weight FROM cw")
def cf_weights(spark, d):
    return M.reader_postings(interactions(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {INTER_SQL}, {SEEDS_SQL}, {CF_SQL}, {similar_sql('cw', 's')} SELECT query_id, item_id, CAST(round(CAST(score AS DECIMAL(18, 9)), 6) AS DOUBLE) AS score FROM s")
def cf_similar(spark, d):
    return R.rounded(M.similar(seeds(spark), M.reader_postings(interactions(spark, d)))).withColumn("score", six())


def cf_best(spark, d, least=MIN_READERS, who=None, k=10):
    """The best by common readers, of all items with enough readers."""
    inter = R.written(interactions(spark, d))
    supported = pop.readers(inter).where(c("n_readers") >= least)
    return M.best_similar(seeds(spark) if who is None else who, R.written(M.reader_postings(inter)), k, supported)


def supported_sql(least: int) -> str:
    return f"WITH {INTER_SQL}, {SEEDS_SQL}, {CF_SQL}, {similar_sql('cw', 's')}, sup AS (SELECT s.* FROM s SEMI JOIN (SELECT item_id FROM readers WHERE n_readers >= {least}) r ON s.item_id = r.item_id), {top_sql('sup')}"


@query(supported_sql(MIN_READERS))
def cf_recommend(spark, d):
    return listed(cf_best(spark, d), spark)


@query(supported_sql(25))
def cf_recommend_supported(spark, d):
    """As cf_recommend, but for items with 25 readers, which leaves some out in every table."""
    return listed(cf_best(spark, d, 25), spark)


@query(f"WITH {BOTH_SQL}, {SEEDS_SQL}, {DENSE_SQL} SELECT query_id, item_id, CAST(round(CAST(score AS DECIMAL(18, 9)), 6) AS DOUBLE) AS score FROM dense")
def embedding_similar(spark, d):
    v = vectors(spark, d)
    return R.rounded(M.dense_similar(M.dense_profiles(seeds(spark), v), v)).withColumn("score", six())


@query(f"WITH {BOTH_SQL}, {SEEDS_SQL}, {DENSE_SQL}, {top_sql('dense')}")
def embedding_recommend(spark, d):
    v = vectors(spark, d)
    return listed(M.dense_similar(M.dense_profiles(seeds(spark), v), v), spark)


ASKED = [0.25 if i % 3 == 0 else -0.125 if i % 3 == 1 else 0.0 for i in range(64)]


@query(f"SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id AS item_id, round(s, 4) AS score FROM (SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({ASKED} AS DOUBLE[])), 9) AS s FROM embeddings) QUALIFY rank <= 10")
def semantic_search(spark, d):
    """A given query vector against every item."""
    asked = spark.createDataFrame([(1, ASKED)], "query_id int, profile array<double>")
    return R.top_k(M.dense_similar(asked, vectors(spark, d)), 10).select("rank", "item_id", F.round("score", 4).alias("score"))


@query()
def embed_batch(spark, d):
    """Vectors by the stand-in embedder, made in batches on the executors."""
    return U.embed(documents(spark, d), lambda: U.hashed_words)


# --- popularity -----------------------------------------------------------------------------------------------

PCT = "CASE WHEN {0} > 0 THEN (rank() OVER (PARTITION BY {0} > 0 ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2) / count(*) OVER (PARTITION BY {0} > 0) END"
ITEM_SQL = "it AS (SELECT p_partkey AS item_id, coalesce(n_readers, 0) AS n_readers, p_size % 5 AS size FROM part LEFT JOIN readers ON p_partkey = item_id)"
POP_SQL = f"pc AS (SELECT item_id, {PCT.format('n_readers')} AS a, {PCT.format('size')} AS b FROM it)"


def item_counts(spark, d, inter=None):
    items = table(spark, d, "part").select(c("p_partkey").alias("item_id"), (c("p_size") % 5).alias("size"))
    joined = items.join(pop.readers(interactions(spark, d) if inter is None else inter), "item_id", "left")
    return joined.withColumn("n_readers", F.coalesce("n_readers", lit(0)))


@query(f"WITH {INTER_SQL}, {ITEM_SQL}, {POP_SQL} SELECT item_id, round(b, 6) AS percentile FROM pc")
def popularity_percentile(spark, d):
    return pop.percentile(item_counts(spark, d), "size", "p").select("item_id", F.round("p", 6).alias("percentile"))


@query(f"WITH {INTER_SQL}, {ITEM_SQL}, {POP_SQL} SELECT item_id, round(coalesce(greatest(a, b), 0), 6) AS popularity FROM pc")
def popularity_scores_max(spark, d):
    return pop.popularity(item_counts(spark, d), ("n_readers", "size")).select("item_id", F.round("popularity", 6).alias("popularity"))


@query(f"WITH {INTER_SQL}, {ITEM_SQL}, {POP_SQL} SELECT item_id, round(coalesce(list_avg([a, b]), 0), 6) AS popularity FROM pc")
def popularity_scores_mean(spark, d):
    return pop.popularity(item_counts(spark, d), ("n_readers", "size"), "mean").select("item_id", F.round("popularity", 6).alias("popularity"))


READ_SQL = f"{ITEM_SQL}, {POP_SQL}, pp AS (SELECT item_id, coalesce(a, 0) AS popularity FROM pc)"


def item_popularity(spark, d, inter=None):
    return pop.popularity(item_counts(spark, d, inter), ("n_readers",)).select("item_id", "popularity")


@query(f"WITH {INTER_SQL}, {READ_SQL} SELECT item_id, round(popularity, 4) AS score FROM pp ORDER BY round(popularity, 9) DESC, item_id LIMIT 10")
def popular(spark, d):
    return item_popularity(spark, d).orderBy(F.desc(F.round("popularity", 9)), "item_id").limit(10).select("item_id", F.round("popularity", 4).alias("score"))


@query("SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3")
def top_k_per_query(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return R.first_k(rows, 3, ["l_suppkey"], [F.desc("l_extendedprice"), c("l_orderkey"), c("l_linenumber"), c("l_partkey")])


# --- fusion ---------------------------------------------------------------------------------------------------

BOTH_RANKS = f"{BOTH_SQL}, {SEEDS_SQL}, {tfidf_sql('d')}, {similar_sql('t', 's')}, {completed_sql('s', 'd', 's0')}, {ranked_sql('s0', 'r1')}, {DENSE_SQL}, dv AS (SELECT dense.* FROM dense SEMI JOIN d ON dense.item_id = d.item_id), {ranked_sql('dv', 'r2')}"
RRF = "round({0} / (60 + r1.rank) + (1 - {0}) / (60 + r2.rank), 9)"
BOTH_RRF = f"{BOTH_RANKS}, rrf AS (SELECT query_id, item_id, {RRF.format('0.5::DOUBLE')} AS score FROM r1 JOIN r2 USING (query_id, item_id))"
PART_RANKS = f"{INTER_SQL}, {PARTS_SQL}, {SEEDS_SQL}, {tfidf_sql('d')}, {similar_sql('t', 's')}, {completed_sql('s', 'd', 's0')}, {ranked_sql('s0', 'r1')}, {CF_SQL}, {similar_sql('cw', 'cs')}, sup AS (SELECT item_id FROM readers WHERE n_readers >= {MIN_READERS}), {completed_sql('cs', 'sup', 'c0')}, {ranked_sql('c0', 'r2')}"
PART_RRF = f"{PART_RANKS}, rrf AS (SELECT query_id, item_id, {RRF.format('0.5::DOUBLE')} AS score FROM r1 JOIN r2 USING (query_id, item_id))"


def both_scores(spark, d, who=None):
    """((scores, items) by TF-IDF over all documents, (scores, items) by vector over those that have one)."""
    docs, v, who = documents(spark, d).select("item_id", "text"), vectors(spark, d), seeds(spark) if who is None else who
    text = M.similar(who, M.tfidf(docs))
    return (text, docs.select("item_id")), (M.dense_similar(M.dense_profiles(who, v), v), v.select("item_id").join(docs, "item_id", "left_semi").select("item_id"))


def part_scores(spark, d, inter=None):
    """((scores, items) by TF-IDF over all parts, (scores, items) by readers over those with enough)."""
    items, inter = parts(spark, d), R.written(interactions(spark, d)) if inter is None else inter
    supported = R.written(pop.readers(inter).where(c("n_readers") >= MIN_READERS).select("item_id"))
    return (M.similar(seeds(spark), M.tfidf(items)), items.select("item_id")), (M.similar(seeds(spark), R.written(M.reader_postings(inter, seeds(spark)))), supported)


def heads(spark, pair, k, alphas=(0.5,)):
    """(query_id, item_id, alpha, score), the k best of the fusion among them."""
    first, second = (fusion.rank_list(R.written(scores), fusion.placed(items)) for scores, items in pair)
    return fusion.fused_heads(first, second, seeds(spark), k, alphas, 2)


@query(f"WITH {BOTH_RRF} SELECT query_id, item_id, score FROM rrf")
def hybrid_rrf(spark, d):
    """Every item's fused score: the one query that wants all ranks as rows."""
    ranks = [R.ranked(R.completed(scores.join(items, "item_id", "left_semi"), items, QUERY_IDS)) for scores, items in both_scores(spark, d)]
    return R.fused(*ranks).select("query_id", "item_id", "score")


@query(f"WITH {BOTH_RRF}, {top_sql('rrf')}")
def hybrid_recommend(spark, d):
    return listed(heads(spark, both_scores(spark, d), 10), spark)


@query(f"WITH {PART_RRF}, {top_sql('rrf')}")
def hybrid_cf_recommend(spark, d):
    return listed(heads(spark, part_scores(spark, d), 10), spark)


@query(f"WITH {BOTH_RANKS}, rrf AS (SELECT alpha, query_id, item_id, {RRF.format('alpha')} AS score FROM r1 JOIN r2 USING (query_id, item_id), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)) SELECT alpha, query_id, item_id, CAST(row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM rrf ANTI JOIN seeds USING (query_id, item_id) QUALIFY rank <= 10")
def alpha_sweep(spark, d):
    return R.top_k(heads(spark, both_scores(spark, d), 10, (0.0, 0.25, 0.5, 0.75, 1.0)), 10, "alpha", "query_id").select("alpha", "query_id", "item_id", "rank")


RERANK_SQL = f"""{{0}}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS n FROM rrf ANTI JOIN seeds USING (query_id, item_id)) WHERE n <= 200),
blend AS (SELECT query_id, item_id, round(0.8::DOUBLE * sim + 0.2::DOUBLE * coalesce(popularity, 0), 9) AS score, sim FROM (SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-12) AS sim FROM cand) LEFT JOIN pp USING (item_id))"""


def part_reranked(spark, d):
    inter = R.written(interactions(spark, d))
    near = R.written(heads(spark, part_scores(spark, d, inter), 200).select("query_id", "item_id", "score"))
    return R.reranked(near, item_popularity(spark, d, inter))


@query(f"WITH {RERANK_SQL.format(PART_RRF + ', ' + READ_SQL)} SELECT query_id, item_id, round(score, 6) AS score, round(sim, 6) AS similarity FROM blend")
def popularity_rerank(spark, d):
    return part_reranked(spark, d).select("query_id", "item_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {RERANK_SQL.format(PART_RRF + ', ' + READ_SQL)}, {top_sql('blend')}")
def hybrid_popular_recommend(spark, d):
    return listed(part_reranked(spark, d), spark)


OWN = [(1, 3)]


@query(f"WITH {BOTH_SQL}, {SEEDS_SQL}, {DENSE_SQL}, a AS (SELECT query_id, item_id, score, v.label, o.label AS own FROM dense JOIN v USING (item_id) JOIN seeds s USING (query_id) JOIN v o ON o.item_id = s.item_id WHERE query_id = 1 AND dense.item_id <> s.item_id), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, item_id) AS nth FROM a) SELECT item_id, round(score, 4) AS score FROM n WHERE nth <= CASE WHEN label = own THEN 1 ELSE 2 END ORDER BY n.score DESC, item_id LIMIT 12".replace("dense JOIN v USING (item_id) JOIN", "dense JOIN v ON v.item_id = dense.item_id JOIN").replace("SELECT query_id, item_id, score, v.label", "SELECT query_id, dense.item_id AS item_id, score, v.label"))
def author_capped_topk(spark, d):
    v = vectors(spark, d)
    one = seeds(spark).where("query_id = 1")
    authors = v.select("item_id", c("label").alias("author"))
    own = one.join(authors, "item_id").select("query_id", c("author").alias("own_author"))
    scores = R.without_seeds(M.dense_similar(M.dense_profiles(one, v), v), one)
    return R.top_k(R.capped(scores, authors, own, 2, 1), 12).select("item_id", F.round("score", 4).alias("score"))


RULES_SQL = f"""pn AS (SELECT doc_id AS item_id, source AS author, {DIGEST_SQL} AS dedup_key, {PCT.format('n_chars')} AS popularity FROM documents), pp AS (SELECT item_id, popularity FROM pn)"""


@query(
    f"WITH {RERANK_SQL.format(BOTH_RRF + ', ' + RULES_SQL)}, one AS (SELECT blend.*, pn.author, pn.dedup_key, o.author AS own_author, o.dedup_key AS own_key FROM blend JOIN pn ON pn.item_id = blend.item_id JOIN pn o ON o.item_id = 3 WHERE query_id = 1),"
    " u AS (SELECT * FROM one WHERE dedup_key IS NOT NULL AND dedup_key IS DISTINCT FROM own_key QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY score DESC, item_id) = 1),"
    " k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY author ORDER BY score DESC, item_id) <= CASE WHEN author = own_author THEN 0 ELSE 2 END)"
    " SELECT item_id, round(score, 4) AS score, author FROM k ORDER BY k.score DESC, item_id LIMIT 10"
)
def hybrid_business_rules(spark, d):
    """Fusion, 200 candidates, popularity blend, one per text, two per author, none of the query's own author or text."""
    docs = documents(spark, d)
    items = R.written(pop.popularity(docs.select("item_id", "n_chars", c("source").alias("author")), ("n_chars",)).select("item_id", "popularity", "author"))
    one = spark.createDataFrame(OWN, "query_id int, item_id long")
    first, second = (fusion.rank_list(R.written(scores), fusion.placed(known)) for scores, known in both_scores(spark, d, one))
    near = fusion.fused_heads(first, second, one, 200)
    scores = R.written(R.reranked(near.select("query_id", "item_id", "score"), items).select("query_id", "item_id", "score"))
    # Of all texts only the candidates' and the query's own are compared.
    asked = R.written(scores.select("item_id").union(one.select("item_id")).distinct())
    keys = R.written(docs.join(asked, "item_id", "left_semi").select("item_id", F.md5(X.normalized_text(c("text"))).alias("dedup_key")))
    own = one.join(items, "item_id").join(keys, "item_id")
    unique = R.first_copies(scores, keys.where("dedup_key is not null"), own.select("query_id", c("dedup_key").alias("own_key"))).select("query_id", "item_id", "score")
    kept = R.capped(unique, items, own.select("query_id", c("author").alias("own_author")), 2, 0)
    return R.top_k(kept, 10).select("item_id", F.round("score", 4).alias("score"), "author")


# --- title search ---------------------------------------------------------------------------------------------


def grams_sql(source: str) -> str:
    """CTEs g_tf, g_idf and g over source (item_id, title)."""
    return f"""g_w AS (SELECT item_id, unnest(string_split(coalesce({title_sql('title')}, ''), ' ')) AS w FROM {source}),
g_tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_transform(range(1, len(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS term FROM g_w WHERE w <> '') GROUP BY item_id, term),
g_idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM g_tf, (SELECT count(*) AS n FROM {source}) GROUP BY term, n),
g AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS weight FROM (SELECT item_id, term, tf * idf AS x FROM g_tf JOIN g_idf USING (term)))"""


def match_sql(asked: str) -> str:
    return f"""q_tf AS (SELECT term, count(*) AS tf FROM (SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS term FROM (SELECT unnest(string_split('{asked}', ' ')) AS w)) GROUP BY term),
q AS (SELECT term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER ()) AS w FROM q_tf JOIN g_idf USING (term)),
m AS (SELECT item_id, round(sum(weight * w), 9) AS match FROM g JOIN q USING (term) GROUP BY item_id)"""


NAMES_SQL = "tn AS (SELECT min(p_partkey) AS item_id, p_name AS title, min_by(p_type, p_partkey) AS author, min_by(p_size, p_partkey) AS size FROM part GROUP BY p_name)"
SEARCH_SQL = f"""WITH {INTER_SQL}, {NAMES_SQL}, {ITEM_SQL}, {POP_SQL}, pp AS (SELECT item_id, coalesce(a, 0) AS popularity FROM pc), {grams_sql('tn')}, {{0}},
r AS (SELECT item_id, title, match, round(match + 0.05::DOUBLE * CAST(size >= 15 AS INTEGER) + 0.05::DOUBLE * CAST(author IS NOT NULL AS INTEGER) + 0.1::DOUBLE * popularity, 9) AS ranked FROM m JOIN tn USING (item_id) JOIN pp USING (item_id)),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY ranked DESC, item_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 5),
k AS (SELECT * FROM n WHERE rank < coalesce((SELECT min(rank) FROM n WHERE match < 0.6), 99)),
st AS (SELECT coalesce(bool_or(rank = 1 AND match >= 0.9 AND (nx IS NULL OR ranked - nx >= 0.1::DOUBLE - 1e-12)), false) AS ok FROM (SELECT *, lead(ranked) OVER (ORDER BY ranked DESC, item_id) AS nx FROM k)),
found AS (SELECT k.item_id, title, rank, match, CASE WHEN ok THEN 'match' ELSE 'did_you_mean' END AS status FROM k, st WHERE NOT ok OR rank = 1)"""


def search_sql(asked: str) -> str:
    return SEARCH_SQL.replace("{0}", match_sql(asked))


def named_items(spark, d):
    """One item per title, with what the search needs."""
    first = first_of(table(spark, d, "part").select(c("p_name").alias("title"), c("p_partkey").alias("item_id"), c("p_type").alias("author"), (c("p_size") >= 15).alias("has_description")), ["title"], c("item_id"))
    return first.join(item_popularity(spark, d), "item_id")


@query(f"WITH {NAMES_SQL}, {grams_sql('tn')} SELECT item_id, term, round(weight, 6) AS weight FROM g")
def title_ngrams(spark, d):
    return M.trigrams(named_items(spark, d))[0].withColumn("weight", F.round("weight", 6))


@query(f"WITH {NAMES_SQL}, {grams_sql('tn')}, {match_sql('smal rings')} SELECT item_id, round(match, 6) AS match FROM m")
def title_match(spark, d):
    return S.TitleIndex(named_items(spark, d)).scores("The Smal Rings").withColumn("match", F.round("match", 6))


@query(f"{search_sql('smal rings')} SELECT item_id, title, rank, round(match, 3) AS match, status FROM found")
def title_search(spark, d):
    return S.search(named_items(spark, d), "Smal Rings").select("item_id", "title", "rank", F.round("match", 3).alias("match"), "status")


@query(f"{search_sql('blue gear')} SELECT item_id, title, rank, round(match, 3) AS match, status FROM found")
def title_search_status(spark, d):
    return S.search(named_items(spark, d), "Blue Gear").select("item_id", "title", "rank", F.round("match", 3).alias("match"), "status")


@query(f"{search_sql('blue gear')}, seeds AS (SELECT 1 AS query_id, item_id FROM found WHERE status = 'match'), {CF_SQL}, {similar_sql('cw', 's')}, {top_sql('s')}".replace("FROM s ANTI", "FROM (SELECT s.* FROM s SEMI JOIN (SELECT item_id FROM readers WHERE n_readers >= 5) o USING (item_id)) s ANTI"))
def recommend_by_title(spark, d):
    """A clear match becomes the seed; without one there is no list."""
    found = S.search(named_items(spark, d), "Blue Gear").where("status = 'match'").select(lit(1).alias("query_id"), "item_id")
    found = R.written(found)
    return R.top_k(cf_best(spark, d, who=found), 10).select("query_id", "item_id", "rank", F.round("score", 4).alias("score"))


@query("SELECT p_partkey AS item_id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_size DESC, p_partkey LIMIT 10")
def find_substring(spark, d):
    items = table(spark, d, "part").select(c("p_partkey").alias("item_id"), c("p_name").alias("title"), c("p_size").alias("popularity"))
    return S.find_substring(items, "Ring", 10).select("item_id", "title")


@query("SELECT p_partkey AS item_id, p_name AS title, p_type || '|' || p_brand AS tags FROM part WHERE p_partkey = 12")
def item_details(spark, d):
    return table(spark, d, "part").where("p_partkey = 12").select(c("p_partkey").alias("item_id"), c("p_name").alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("tags"))


# --- the engine -----------------------------------------------------------------------------------------------


def part_engine(spark, d):
    """The engine over the parts, all of them described, by the popularity of their readers."""
    items = table(spark, d, "part").select(
        c("p_partkey").alias("item_id"), c("p_name").alias("title"), c("p_type").alias("author"), lit(None).cast("string").alias("description"), F.array("p_type", "p_brand").alias("tags"), lit(True).alias("has_description")
    )
    counts = item_counts(spark, d).select("item_id", "n_readers")
    return Engine(items.join(counts, "item_id"), ("n_readers",), None, interactions(spark, d))


ONE_SQL = PART_RRF.replace(SEEDS_SQL, "seeds AS (SELECT 1 AS query_id, 3 AS item_id)")


@query(f"SELECT item_id, rank, score, p_name AS title, p_type AS author FROM (WITH {ONE_SQL}, {top_sql('rrf')}) JOIN part ON item_id = p_partkey")
def engine_recommend(spark, d):
    return part_engine(spark, d).recommend([3, 3], "hybrid_cf", 10).select("item_id", "rank", "score", "title", "author")


@query(f"SELECT item_id, CAST(row_number() OVER (ORDER BY round(popularity, 9) DESC, item_id) AS INTEGER) AS rank, round(popularity, 4) AS score FROM (WITH {INTER_SQL}, {READ_SQL} SELECT * FROM pp) QUALIFY rank <= 10")
def engine_popular(spark, d):
    return part_engine(spark, d).popular(10).select("item_id", "rank", "score")
