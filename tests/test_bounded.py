"""The bounded search against adding up every pair that shares a term, and how few pairs it needs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking as R
from tidemark.operators import similarity as M


@pytest.fixture(scope="module")
def postings(spark):
    """600 items over words of very unequal frequency, as unit-length postings."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [(i, " ".join(words[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(3, 14)))) for i in range(600)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    return M.tfidf(items, 1, 1.0)


@pytest.mark.parametrize("k", [1, 10, 700])
def test_the_best_equal_those_of_all_pairs(spark, postings, k):
    seeds = spark.createDataFrame([(q, i) for q in range(40) for i in ([q] if q % 3 else [q, q + 200, q + 300])] + [(90, 5000)], "query_id long, item_id long")
    some = postings.select("item_id").distinct().where("item_id % 5 <> 2")
    for items in (None, some):
        whole = M.similar(seeds, postings)
        whole = R.top_k(R.without_seeds(whole if items is None else whole.join(items, "item_id", "left_semi"), seeds), k)
        show = lambda df: {(r["query_id"], r["rank"]): (r["item_id"], round(r["score"], 7)) for r in df.collect()}
        assert show(R.top_k(M.best_similar(seeds, postings, k, items), k)) == show(whole)


def test_few_pairs_are_scored(spark, postings):
    seeds = spark.createDataFrame([(q, q) for q in range(40)], "query_id long, item_id long")
    every = R.without_seeds(M.similar(seeds, postings), seeds).count()
    found = M.bounded(seeds, postings, 10)
    assert found.candidates.count() < every / 2
    needed = found.essential.where("needed").agg(F.sum("df")).first()[0]
    assert needed < 0.75 * found.profile.agg(F.sum("df")).first()[0]


def test_look_ups_open_few_folders_and_move_no_postings(spark, postings):
    index = M.PostingIndex(postings)
    seeds = spark.createDataFrame([(1, 5), (1, 77)], "query_id int, item_id long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = index.of("item_id", seeds)
    opened = plan(found)
    assert "PartitionFilters: [isnotnull(bucket" in opened or "PartitionFilters: [bucket" in opened
    assert "Exchange" not in opened and found.select(F.input_file_name()).distinct().count() <= 2
    profile = R.written(M.profiles(seeds, index)).where("weight > 0.3").limit(3)
    moved = plan(F.broadcast(profile).join(index.of("term", profile), "term"))
    assert "hashpartitioning(term" not in moved and "BroadcastHashJoin" in moved
    show = lambda df: {(r["query_id"], r["item_id"]): round(r["score"], 9) for r in df.collect()}
    assert show(M.similar(seeds, index)) == show(M.similar(seeds, postings))
    assert show(R.top_k(M.best_similar(seeds, index, 7), 7)) == show(R.top_k(M.best_similar(seeds, postings, 7), 7))
