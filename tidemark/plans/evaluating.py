"""Queries of the leave-one-out evaluation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udf as U
from ..operators import evaluation as E
from ..operators import popularity as pop
from ..operators import ranking as R
from ..operators import similarity as M
from ..operators import models
from ..sources.tables import table
from .cleaning import INTER_SQL, interactions, key_sql
from .modelling import ITEM_SQL, MIN_READERS, PARTS_SQL, PCT, completed_sql, item_counts, parts, ranked_sql, similar_sql, tfidf_sql
from .registry import query

c, lit = F.col, F.lit
#: Readers of a test set at most, and the seed of their order.
READERS, SEED = 2000, 42
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
MODELS = ["popularity", "tfidf", "embeddings", "hybrid", "hybrid_popular", "cf", "hybrid_cf"]
LIKED_SQL = f"{INTER_SQL}, liked AS (SELECT user_id, item_id FROM inter SEMI JOIN (SELECT p_partkey FROM part WHERE p_size >= 15) ON item_id = p_partkey WHERE rating >= 7)"
ALL_PAIRS_SQL = f"""{LIKED_SQL}, two AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || item_id), item_id) AS n FROM liked),
q AS (SELECT user_id AS query_id, max(item_id) FILTER (n = 1) AS query, max(item_id) FILTER (n = 2) AS target FROM two WHERE n <= 2 GROUP BY user_id HAVING count(*) = 2 ORDER BY md5('42:' || user_id), user_id LIMIT {READERS})"""
RELATED_SQL = f"""{LIKED_SQL}, tg AS (SELECT user_id, item_id, tag FROM liked JOIN (SELECT p_partkey, unnest([lower(p_type), lower(p_brand)]) AS tag FROM part) ON item_id = p_partkey),
two AS (SELECT *, row_number() OVER (PARTITION BY user_id, tag ORDER BY md5('42:' || user_id || ':' || item_id), item_id) AS n FROM tg),
b AS (SELECT user_id, tag, max(item_id) FILTER (n = 1) AS query, max(item_id) FILTER (n = 2) AS target FROM two WHERE n <= 2 GROUP BY 1, 2 HAVING count(*) = 2),
related AS (SELECT user_id, query, target, tag FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || tag)) = 1 ORDER BY md5('42:' || user_id), user_id LIMIT {READERS})"""
#: The stand-in embedder: signed sums of word digests, scaled to unit length, as floats.
EMBED_SQL = """ew AS (SELECT item_id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS w FROM d),
ed AS (SELECT item_id, CAST(list_sum(list_transform(range(1, len(w) + 1), lambda i: i * ascii(substr(w, i, 1)))) AS BIGINT) AS g FROM ew WHERE w <> ''),
ec AS (SELECT item_id, g % 64 AS k, sum(CASE WHEN (g // 64) % 2 = 1 THEN 1 ELSE -1 END) AS x FROM ed GROUP BY ALL),
ev AS (SELECT item_id, k, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS FLOAT) AS DOUBLE) AS x FROM ec QUALIFY sum(x * x) OVER (PARTITION BY item_id) > 0)"""


def _fused_sql(name: str, first: str, second: str, alpha: str) -> str:
    return f"{name} AS (SELECT {alpha} AS alpha, query_id, item_id, round({alpha} / (60 + {first}.rank) + (1 - {alpha}) / (60 + {second}.rank), 9) AS score FROM {first} JOIN {second} USING (query_id, item_id))"


def scores_sql(pairs: str) -> str:
    """Scores and ranks of every model for the queries q (query_id, query, target) of some pairs, every item with every query."""
    return f"""{pairs}, seeds AS (SELECT query_id, query AS item_id FROM q), train AS (SELECT inter.* FROM inter ANTI JOIN q ON user_id = query_id AND inter.item_id = target), tr AS (SELECT item_id, count(*) AS n_readers FROM train GROUP BY 1),
it AS (SELECT p_partkey AS item_id, p_type AS author, p_size >= 15 AS described, greatest(coalesce(readers.n_readers, 0) - coalesce(h, 0), 0) AS n_readers FROM part LEFT JOIN readers ON p_partkey = readers.item_id LEFT JOIN (SELECT target, count(*) AS h FROM q GROUP BY 1) ON target = p_partkey),
pp AS MATERIALIZED (SELECT item_id, author, described, {key_sql("author")} AS key, coalesce({PCT.format("n_readers")}, 0) AS popularity FROM it),
content AS (SELECT item_id FROM pp WHERE described), supported AS (SELECT item_id FROM content SEMI JOIN (SELECT item_id FROM tr WHERE n_readers >= {MIN_READERS}) USING (item_id)),
{PARTS_SQL}, {tfidf_sql("d")}, {similar_sql("t", "t_all")}, {completed_sql("t_all", "content", "t_0")}, {ranked_sql("t_0", "t_r")},
cw AS (SELECT item_id, user_id AS term, 1 / sqrt(n_readers) AS weight FROM train JOIN tr USING (item_id)), {similar_sql("cw", "c_all")}, {completed_sql("c_all", "supported", "c_0")}, {ranked_sql("c_0", "c_r")},
{EMBED_SQL}, e_all AS (SELECT query_id, b.item_id, round(sum(a.x * b.x), 9) AS score FROM seeds JOIN ev a USING (item_id) JOIN ev b USING (k) GROUP BY ALL), {completed_sql("e_all", "content", "e_0")}, {ranked_sql("e_0", "e_r")}"""


def eval_sql(pairs: str) -> str:
    """Lists of all models (top), and the rank of each query's target in them (ranks)."""
    return f"""{scores_sql(pairs)}, {_fused_sql("h", "t_r", "e_r", "0.5::DOUBLE")}, {_fused_sql("hc", "t_r", "c_r", "0.5::DOUBLE")},
cand AS (SELECT * FROM h ANTI JOIN seeds USING (query_id, item_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 200),
hp AS (SELECT query_id, item_id, round(0.8::DOUBLE * sim + 0.2::DOUBLE * popularity, 9) AS score FROM (SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) + 1e-12) AS sim FROM cand) JOIN pp USING (item_id)),
every AS (SELECT 'tfidf' AS model, query_id, item_id, score FROM t_0 WHERE score > 0 UNION ALL SELECT 'embeddings', query_id, item_id, score FROM e_0 WHERE score > 0 UNION ALL SELECT 'cf', query_id, item_id, score FROM c_0 WHERE score > 0
  UNION ALL SELECT 'hybrid', query_id, item_id, score FROM h UNION ALL SELECT 'hybrid_cf', query_id, item_id, score FROM hc UNION ALL SELECT 'hybrid_popular', query_id, item_id, score FROM hp
  UNION ALL SELECT 'popularity', query_id, item_id, round(popularity, 9) FROM q, (SELECT * FROM pp ORDER BY round(popularity, 9) DESC, item_id LIMIT 11)),
top AS MATERIALIZED (SELECT model, query_id, item_id, score, CAST(row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM every ANTI JOIN seeds USING (query_id, item_id) QUALIFY rank <= 10),
ranks AS (SELECT md.model, q.query_id, coalesce(rank, 0) AS target_rank FROM q CROSS JOIN (SELECT unnest({MODELS}) AS model) md LEFT JOIN top ON top.model = md.model AND top.query_id = q.query_id AND top.item_id = target)"""


def liked(spark, d, inter=None):
    described = table(spark, d, "part").where("p_size >= 15").select(c("p_partkey").alias("item_id"))
    return E.liked(interactions(spark, d) if inter is None else inter, described)


def tags(spark, d):
    return table(spark, d, "part").select(c("p_partkey").alias("item_id"), F.explode(X.informative_tags(F.array("p_type", "p_brand"))).alias("tag"))


def pairs(spark, d, inter=None):
    """(query_id, query, target); the reader is the query's id."""
    return E.test_pairs(liked(spark, d, inter), READERS, SEED).withColumnRenamed("user_id", "query_id")


def training(inter, q):
    """Interactions without the hidden pairs."""
    return inter.join(q.select(c("query_id").alias("user_id"), c("target").alias("item_id")), ["user_id", "item_id"], "left_anti")


def safe_popularity(spark, d, q, inter):
    hidden = q.select(c("target").alias("item_id"))
    counts = pop.without_hidden(item_counts(spark, d, inter), hidden)
    authors = table(spark, d, "part").select(c("p_partkey").alias("item_id"), c("p_type").alias("author"))
    return pop.popularity(counts, ("n_readers",)).join(authors, "item_id").select("item_id", "author", "popularity")


def test_sets(spark, d, n=READERS, inter=None):
    """Both test sets (query_id, query, target): any two liked items of a reader, and two that share a tag."""
    good = R.written(liked(spark, d, inter))
    sets = {"all_pairs": E.test_pairs(good, n, SEED), "related_pairs": E.related_pairs(good, tags(spark, d), n, SEED)}
    return {name: R.written(q.select(c("user_id").alias("query_id"), "query", "target")) for name, q in sets.items()}


def shared(spark, d, names=MODELS):
    """What no test set changes: written interactions, and the text postings and vectors of the parts if a named model has them."""
    text = parts(spark, d)
    tfidf = M.tfidf(text) if set(names) - {"popularity", "cf"} else None
    vectors = R.written(U.embed(text, lambda: U.hashed_words)) if set(names) - {"popularity", "tfidf", "cf", "hybrid_cf"} else None
    return R.written(interactions(spark, d)), tfidf, vectors


def modelled(spark, d, q, parts_of):
    """(items, models, lists maker) for one test set, without its hidden pairs."""
    inter, tfidf, vectors = parts_of
    described = table(spark, d, "part").select(c("p_partkey").alias("item_id"), (c("p_size") >= 15).alias("has_description"))
    items = R.written(safe_popularity(spark, d, q, inter).join(described, "item_id"))
    cf = R.written(M.reader_postings(training(inter, q)))
    return items, models.standard(items, tfidf, vectors, cf, MIN_READERS), models.Lists(q.select("query_id", c("query").alias("item_id")), 1)


def listed(spark, d, q, parts_of, names=MODELS):
    """(items, top lists of the named models) for one test set."""
    items, known, made = modelled(spark, d, q, parts_of)
    some = [m for m in known if m.name in names]
    made.prepare(some)
    return items, made.every(some)[0]


def lists(spark, d, names=MODELS):
    """(queries, items, top lists of the named models) of the readers of all_pairs."""
    parts_of = shared(spark, d, names)
    q = R.written(pairs(spark, d, parts_of[0]))
    return q, *listed(spark, d, q, parts_of, names)


@query(f"WITH {LIKED_SQL} SELECT * FROM liked")
def liked_pairs(spark, d):
    return liked(spark, d)


@query(f"WITH {LIKED_SQL} SELECT user_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM liked GROUP BY 1 HAVING count(*) >= 2")
def liked_per_reader(spark, d):
    return E.liked_per_reader(liked(spark, d)).select("user_id", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("items"))


@query(f"WITH {ALL_PAIRS_SQL} SELECT * FROM q")
def make_queries(spark, d):
    return pairs(spark, d)


@query(f"WITH {RELATED_SQL} SELECT * FROM related")
def related_pairs(spark, d):
    return E.related_pairs(liked(spark, d), tags(spark, d), READERS, SEED)


@query(f"WITH {ALL_PAIRS_SQL}, {ITEM_SQL} SELECT it.item_id, greatest(n_readers - coalesce(h, 0), 0) AS n_readers FROM it LEFT JOIN (SELECT target, count(*) AS h FROM q GROUP BY 1) ON target = it.item_id")
def leakage_safe_popularity(spark, d):
    hidden = pairs(spark, d).select(c("target").alias("item_id"))
    return pop.without_hidden(item_counts(spark, d), hidden).select("item_id", "n_readers")


@query(f"WITH {ALL_PAIRS_SQL} SELECT user_id, count(*) AS n FROM inter ANTI JOIN q ON user_id = query_id AND item_id = target GROUP BY 1")
def train_anti_join(spark, d):
    return training(interactions(spark, d), pairs(spark, d)).groupBy("user_id").agg(F.count(lit(1)).alias("n"))


EVAL_SQL = eval_sql(ALL_PAIRS_SQL)


@query(f"WITH {EVAL_SQL} SELECT model, query_id, item_id, rank FROM top")
def eval_topk(spark, d):
    return lists(spark, d)[2].select("model", "query_id", "item_id", "rank")


@query(f"WITH {EVAL_SQL} SELECT * FROM ranks")
def target_ranks(spark, d):
    q, _, top = lists(spark, d)
    return E.target_ranks(top, q, MODELS)


METRICS = ("hit_rate", "std_error", "mrr", "hit_same_author", "hit_other_author", "avg_popularity", "by_query_author")


def metrics_sql(top: str = "top", models: str = f"(SELECT unnest({MODELS}) AS model)") -> str:
    """CTEs that end in m, a row of metrics per model over lists, q and pp."""
    return f"""qa AS (SELECT q.*, a.key AS q_author, coalesce(a.key = b.key, false) AS same FROM q LEFT JOIN pp a ON a.item_id = query LEFT JOIN pp b ON b.item_id = target),
hit AS (SELECT md.model, same, coalesce(rank, 0) AS target_rank FROM qa CROSS JOIN {models} md LEFT JOIN {top} x ON x.model = md.model AND x.query_id = qa.query_id AND x.item_id = target),
hm AS (SELECT model, avg(CAST(target_rank > 0 AS INTEGER)) AS hit_rate, count(*) AS n, avg(CASE WHEN target_rank > 0 THEN 1 / target_rank ELSE 0 END) AS mrr, avg(CAST(target_rank > 0 AS INTEGER)) FILTER (same) AS hit_same_author, avg(CAST(target_rank > 0 AS INTEGER)) FILTER (NOT same) AS hit_other_author FROM hit GROUP BY 1),
lm AS (SELECT model, count(DISTINCT item_id) AS coverage, avg(popularity) AS avg_popularity, avg(CAST(coalesce(key = q_author, false) AS INTEGER)) AS by_query_author FROM {top} JOIN pp USING (item_id) JOIN qa USING (query_id) GROUP BY 1),
m AS (SELECT model, n, coalesce(coverage, 0) AS coverage, {", ".join(f"CAST(round(CAST({x} AS DECIMAL(18, 9)), 4) AS DOUBLE) AS {x}" for x in METRICS if x != "std_error")}, CAST(round(CAST(sqrt(hit_rate * (1 - hit_rate) / n) AS DECIMAL(18, 9)), 4) AS DOUBLE) AS std_error FROM hm LEFT JOIN lm USING (model))"""


def shown(m):
    return m.select("model", "n", "coverage", *[F.round(c(x).cast("decimal(18,9)"), 4).cast("double").alias(x) for x in METRICS])


@query(f"WITH {EVAL_SQL}, {metrics_sql()} SELECT * FROM m")
def eval_metrics(spark, d):
    """Metrics of every model over 2,000 readers."""
    q, items, top = lists(spark, d)
    return shown(E.metrics(top, q, items, MODELS))


@query(f"WITH {EVAL_SQL}, x AS (SELECT query_id, max(target_rank) FILTER (model = 'cf') AS a, max(target_rank) FILTER (model = 'popularity') AS b FROM ranks GROUP BY 1) SELECT count(*) FILTER (a > 0 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b > 0) AS only_b FROM x")
def mcnemar_counts(spark, d):
    q, _, top = lists(spark, d, ["cf", "popularity"])
    ranks = E.target_ranks(top, q, ["cf", "popularity"])
    return E.discordant(ranks.where("model = 'cf'"), ranks.where("model = 'popularity'"))


def compare_sql(name: str, pairs: str) -> str:
    return f"""SELECT * FROM (WITH {eval_sql(pairs)}, {metrics_sql()}, w AS (SELECT a.model, count(*) FILTER (a.target_rank > 0 AND b.target_rank = 0) AS only_model, count(*) FILTER (a.target_rank = 0 AND b.target_rank > 0) AS only_tfidf FROM ranks a JOIN ranks b USING (query_id) WHERE b.model = 'tfidf' GROUP BY 1)
SELECT '{name}' AS test_set, * FROM m JOIN w USING (model))"""


@query(compare_sql("all_pairs", ALL_PAIRS_SQL) + " UNION ALL BY NAME " + compare_sql("related_pairs", RELATED_SQL + ", q AS (SELECT user_id AS query_id, query, target FROM related)"))
def eval_compare(spark, d):
    """Every model on both test sets of 2,000 readers, with the paired counts against tfidf that the test's p-value needs."""
    out, parts_of = None, shared(spark, d)
    sets = test_sets(spark, d, inter=parts_of[0])
    with ThreadPoolExecutor(len(sets)) as pool:
        done = list(pool.map(lambda q: listed(spark, d, q, parts_of), sets.values()))
    for (name, q), (items, top) in zip(sets.items(), done, strict=True):
        against = E.compared(top, q, "tfidf", MODELS).select("model", "only_model", c("only_reference").alias("only_tfidf"))
        one = shown(E.metrics(top, q, items, MODELS)).join(against, "model").withColumn("test_set", lit(name))
        out = one if out is None else out.unionByName(one)
    return out


SWEPT_SQL = f"""{scores_sql(ALL_PAIRS_SQL)}, {_fused_sql("h", "t_r", "e_r", "alpha").replace("alpha AS alpha,", "alpha,").replace("USING (query_id, item_id))", "USING (query_id, item_id), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha))")},
top AS MATERIALIZED (SELECT alpha AS model, query_id, item_id, CAST(row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM h ANTI JOIN seeds USING (query_id, item_id) QUALIFY rank <= 10)"""


@query(f"WITH {SWEPT_SQL}, {metrics_sql(models='(SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS model)')} SELECT model AS alpha, * EXCLUDE (model) FROM m")
def alpha_metrics(spark, d):
    """The metrics of the text and vector hybrid per alpha, over the readers of all_pairs."""
    parts_of = shared(spark, d)
    q = R.written(pairs(spark, d, parts_of[0]))
    items, known, made = modelled(spark, d, q, parts_of)
    hybrid = next(m for m in known if m.name == "hybrid")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(made.ranks, (hybrid.first, hybrid.second)))
    m = shown(E.metrics(R.written(made.swept(hybrid, ALPHAS)), q, items, [f"alpha={a}" for a in ALPHAS]))
    return m.withColumn("alpha", F.substring_index("model", "=", -1).cast("double")).drop("model")
