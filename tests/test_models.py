"""The lists of all models, against arrays and against the engine's one query at a time, and the whole evaluation."""

import bisect
import random

import duckdb
import pytest
import slow_lists
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import evaluation as E
from tidemark.operators import fusion, models
from tidemark.operators import ranking as R
from tidemark.operators import similarity as M
from tidemark.plans import evaluating
from tidemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def small(spark):
    """(items, vectors, interactions): every fourth item has no description, some of those have ten readers; six have no vector."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.sample(words, 4)), f"a{i % 7}", "about " + rng.choice(words), ["t"], i % 4 > 0, rng.randint(0, 9)) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, title string, author string, description string, tags array<string>, has_description boolean, n_readers long")
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60) if i % 10 != 9], "item_id long, vector array<float>")
    pairs = {(u, i) for i in range(60) for u in rng.sample(range(40), 10 if i % 8 == 0 else rng.randint(2, 9))}
    return items, vectors, spark.createDataFrame(sorted(pairs), "user_id long, item_id long")


def key(df):
    return sorted(tuple(r) for r in df.select("model", "query_id", "item_id", "score", "rank").collect())


def test_lists_equal_arrays_and_the_engines(spark, small):
    items, vectors, inter = small
    engine = Engine(items, ("n_readers",), vectors, inter)
    tfidf, cf = M.tfidf(engine.items), M.reader_postings(inter)
    slow = slow_lists.Catalogue(engine.items, tfidf, vectors, cf)
    asked = [(i + 100, i) for i in (0, 1, 7, 30, 59)]
    seeds = spark.createDataFrame(asked, "query_id long, item_id long")
    known = models.standard(engine.items, tfidf, vectors, cf)
    assert [m.name for m in known] == engine.models
    out, took = models.Lists(seeds).every(known)
    assert key(out) == slow_lists.lists(slow, asked)
    assert took.keys() == {m.name for m in known} and len(set(took.values())) == 7
    hybrid = next(m for m in known if m.name == "hybrid")
    assert key(models.Lists(seeds).swept(hybrid, (0.0, 0.3, 0.5, 1.0))) == slow_lists.lists(slow, asked, alphas=(0.0, 0.3, 0.5, 1.0))
    rows = out.collect()
    for model in engine.models:
        got = [r["item_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["model"] == model and r["query_id"] == 107]
        assert got == [r["item_id"] for r in engine.recommend([7], model).collect()], model
    described = {r["item_id"] for r in items.where("has_description").collect()}
    assert {r["item_id"] for r in rows if r["model"] in ("cf", "hybrid_cf")} <= described


@pytest.mark.parametrize("seed", [1, 2])
def test_fused_heads_hold_the_best_of_the_whole_fusion(spark, seed):
    """Against ranks of every item with every query: sparse scores, negative ones, ties, few and no scores, two seeds."""
    rng = random.Random(seed)
    n, queries = 160, range(5)
    all_items = spark.createDataFrame([(i * 3,) for i in range(n)], "item_id long")
    narrow = all_items if seed % 2 == 0 else all_items.where("item_id % 2 = 0 or item_id > 300")
    share = [0.0, 0.03, 0.3, 0.9, 1.0]
    make = lambda low: [(q, i * 3, round(rng.uniform(low, 1), 1)) for q in queries for i in range(n) if rng.random() < share[(q + seed) % 5]]
    first = spark.createDataFrame(make(0), "query_id long, item_id long, score double")
    second = spark.createDataFrame(make(-1), "query_id long, item_id long, score double").join(narrow, "item_id", "left_semi")
    seeds = spark.createDataFrame([(q, i * 3) for q in queries for i in rng.sample(range(n), 1 + q % 2)], "query_id long, item_id long")
    alphas = (0.0, 0.25, 0.5, 0.75, 1.0)
    one, two = R.ranked(R.completed(first, all_items, seeds)), R.ranked(R.completed(second, narrow, seeds))
    a, b = fusion.rank_list(first, fusion.placed(all_items)), fusion.rank_list(second, fusion.placed(narrow))
    for k in (3, 500):
        whole = R.top_k(R.without_seeds(R.sweep(one, two, alphas), seeds), k, "alpha", "query_id")
        heads = fusion.fused_heads(a, b, seeds, k, alphas, 2)
        best = R.top_k(heads, k, "alpha", "query_id")
        show = lambda df: sorted(tuple(r) for r in df.select("alpha", "query_id", "item_id", "score", "rank").collect())
        assert show(best) == show(whole)


def test_items_that_no_list_scores_have_rows_only_up_to_the_depth(spark):
    """Of 4,000 items that score zero in both lists only the first by id are ever rows."""
    items = spark.range(4000).select(F.col("id").alias("item_id"))
    scores = spark.createDataFrame([(1, i, 1.0 / (1 + i)) for i in range(1000, 1050)], "query_id long, item_id long, score double")
    listed = fusion.rank_list(scores, fusion.placed(items))
    seeds = spark.createDataFrame([(1, 1000)], "query_id long, item_id long")
    assert fusion.fused_heads(listed, listed, seeds, 10).count() <= 50 + fusion.depth(11, (0.5,), True)
    assert listed.rows.count() == 50


def test_zero_scores_are_counted_across_bitmaps(spark):
    """Ranks of items that score zero, among 70,000 items: three bitmaps, one of them empty, marks at their ends and in a query without scores."""
    n, rng = 70_000, random.Random(3)
    scored = {1: set(rng.sample(range(n), 9000)), 2: {i for i in rng.sample(range(n), 500) if not 32_768 <= i < 65_536}, 3: set()}
    scores = spark.createDataFrame([(q, i, rng.choice((-0.5, 0.5, 0.25))) for q, ids in scored.items() for i in ids], "query_id long, item_id long, score double")
    high = {q: 0 for q in scored} | {r["query_id"]: r["n"] for r in scores.where("score > 0").groupBy("query_id").count().withColumnRenamed("count", "n").collect()}
    marks = [(q, i) for q in scored for i in {0, 7, 8, 32_767, 32_768, 65_535, 65_536, n - 1, *rng.sample(range(n), 200)}]
    listed = fusion.rank_list(scores, fusion.placed(spark.range(n).withColumnRenamed("id", "item_id")))
    got = {(r["query_id"], r["item_id"]): r["rank"] for r in fusion.ranks_of(listed, spark.createDataFrame(marks, "query_id long, item_id long"), "rank").collect()}
    assert len(got) == len(marks)
    before = {q: sorted(ids) for q, ids in scored.items()}
    for q, i in marks:
        if i not in scored[q]:
            assert got[q, i] == high[q] + 1 + i - bisect.bisect_left(before[q], i)


def test_an_eighth_model_is_listed_fused_and_evaluated(spark, small):
    items, vectors, inter = small
    engine = Engine(items, ("n_readers",), vectors, inter)
    content = engine.items.where("has_description").select("item_id")
    near = models.Scorer("near_ids", lambda seeds: seeds.withColumnRenamed("item_id", "s").join(content).select("query_id", "item_id", (1 / (1 + F.abs(F.col("item_id") - F.col("s")))).alias("score")), content)
    known = models.standard(engine.items, M.tfidf(engine.items), vectors, M.reader_postings(inter))
    known += [near, models.Fusion("near_hybrid", next(m for m in known if m.name == "tfidf"), near)]
    q = spark.createDataFrame([(1, 1, 2), (2, 30, 31), (3, 7, 58)], "query_id long, query long, target long")
    top, _ = models.Lists(q.select("query_id", F.col("query").alias("item_id"))).every(known)
    names = [m.name for m in known] + ["silent"]
    rows = {r["model"]: r for r in E.metrics(R.written(top), q, engine.items, names).collect()}
    assert rows.keys() == set(names) and rows["near_ids"]["hit_rate"] == pytest.approx(2 / 3)
    assert rows["silent"]["hit_rate"] == rows["silent"]["coverage"] == 0 and rows["silent"]["avg_popularity"] is None
    listed = [r["item_id"] for r in top.where("model = 'near_ids' and query_id = 1").orderBy("rank").collect()]
    assert 1 not in listed and listed[:2] == [2, 3]


def test_authors_are_compared_by_their_keys(spark):
    items = spark.createDataFrame([(1, "J.R.R. Tolkien", 0.5), (2, "J. R. R. Tolkien", 0.25), (3, None, 0.0), (4, "Ann Lee", 1.0)], "item_id long, author string, popularity double")
    q = spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "query_id long, query long, target long")
    top = spark.createDataFrame([("m", 1, 2, 1), ("m", 1, 3, 2), ("m", 2, 3, 1), ("m", 2, 1, 2)], "model string, query_id long, item_id long, rank int")
    r = E.metrics(top, q, items, ["m"]).first()
    assert (r["hit_same_author"], r["hit_other_author"], r["coverage"], r["by_query_author"]) == (1.0, 0.0, 3, 0.25)


def test_every_model_is_compared_with_the_reference(spark):
    top = spark.createDataFrame([("tfidf", 1, 10, 1), ("tfidf", 2, 10, 1), ("cf", 1, 10, 1), ("cf", 3, 30, 2), ("cf", 4, 40, 2), ("none", 1, 11, 1)], "model string, query_id long, item_id long, rank int")
    q = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 30), (4, 5, 40), (5, 5, 50)], "query_id long, query long, target long")
    got = {r["model"]: (r["only_model"], r["only_reference"], r["p"]) for r in E.compared(top, q, "tfidf", ["tfidf", "cf", "none", "silent"]).collect()}
    assert got == {"tfidf": (0, 0, 1.0), "cf": (2, 1, E.mcnemar_p(2, 1)), "none": (0, 2, E.mcnemar_p(0, 2)), "silent": (0, 2, E.mcnemar_p(0, 2))}


def test_the_evaluation_takes_all_eligible_readers_models_and_sets(spark):
    folder = "/root/testdata/sf0.001"
    liked = f"SELECT o_custkey AS u, l_partkey AS i, arg_min(l_quantity, (l_orderkey, l_linenumber)) AS q FROM '{folder}/lineitem.parquet' JOIN '{folder}/orders.parquet' ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING q >= 35"
    eligible = duckdb.sql(f"SELECT count(*) FROM (SELECT u FROM ({liked}) SEMI JOIN (SELECT p_partkey FROM '{folder}/part.parquet' WHERE p_size >= 15) ON i = p_partkey GROUP BY u HAVING count(*) >= 2)").fetchall()[0][0]
    rows = QUERIES["eval_compare"](spark, folder).collect()
    assert {(r["test_set"], r["model"]) for r in rows} == {(s, m) for s in ("all_pairs", "related_pairs") for m in evaluating.MODELS}
    assert {r["n"] for r in rows if r["test_set"] == "all_pairs"} == {min(evaluating.READERS, eligible)}
    hybrid = next(r for r in rows if r["test_set"] == "all_pairs" and r["model"] == "hybrid")
    alphas = {r["alpha"]: r for r in QUERIES["alpha_metrics"](spark, folder).collect()}
    assert sorted(alphas) == list(evaluating.ALPHAS)
    assert alphas[0.5]["hit_rate"] == pytest.approx(hybrid["hit_rate"]) and alphas[0.5]["mrr"] == pytest.approx(hybrid["mrr"])
