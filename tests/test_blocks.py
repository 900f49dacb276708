"""Ranks counted in blocks of scores, against ranks of every item with every query, and how little of the scores is written."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, fusion, models
from tidemark.operators import ranking as R
from tidemark.operators import similarity as M


@pytest.fixture(scope="module")
def known(spark):
    """(items, those with text, postings, vectors): copies, items without terms or vector, vectors of two lengths and some of weight zero."""
    rng = random.Random(8)
    words = [f"w{chr(97 + i)}" for i in range(12)]
    text = {i: " ".join(rng.sample(words, 3)) if i % 3 else "wa wb wc" for i in range(0, 400, 2) if i % 11}
    vector = {i: [float(rng.randint(-1, 1)) / 4 for _ in range(3 if i % 7 else 5)] for i in range(0, 400, 2) if i % 13}
    items = spark.createDataFrame([(i,) for i in range(0, 400, 2)], "item_id long")
    postings = M.tfidf(spark.createDataFrame(sorted(text.items()), "item_id long, text string"), 1, 1.0)
    return items, items.where("item_id % 5 <> 4"), postings, R.written(spark.createDataFrame(sorted(vector.items()), "item_id long, vector array<float>"))


def asked(spark):
    """Seeds of 23 queries by names, some with two, one of which nothing is known."""
    return spark.createDataFrame([(f"q{q}", i) for q in range(23) for i in ([q * 14] if q % 3 else [q * 14, q * 10 + 6])] + [("none", 5001)], "query_id string, item_id long")


@pytest.mark.parametrize("size", [17, 1000])
def test_heads_and_ranks_equal_those_of_all_pairs(spark, known, monkeypatch, size):
    items, content, postings, vectors = known
    monkeypatch.setattr(blocks, "ITEMS", size)
    monkeypatch.setattr(blocks, "QUERIES", 5 if size == 17 else 256)
    seeds = asked(spark)
    for make, scores, of in ((blocks.by_terms, M.similar(seeds, postings), postings), (blocks.by_vectors, M.dense_similar(M.dense_profiles(seeds, vectors), vectors), vectors)):
        whole = R.written(R.ranked(R.completed(R.rounded(scores.join(content, "item_id", "left_semi")), content, seeds)))
        show = lambda df, *c: sorted(tuple(r) for r in df.select("query_id", "item_id", *c).collect())
        listed = make(seeds, of, fusion.placed(content))
        assert show(listed.head(20), "score", "rank") == show(whole.where("rank <= 20"), "score", "rank")
        assert show(listed.head(300), "rank") == show(whole, "rank")
        fresh = make(seeds, of, fusion.placed(content))
        fresh.head(9)
        assert show(fresh.ranks_of(whole.select("query_id", "item_id"), "r"), "r") == show(whole, "rank")


@pytest.mark.parametrize("narrow", [False, True])
def test_fusions_of_blocks_and_rows_agree(spark, known, monkeypatch, narrow):
    items, content, postings, vectors = known
    monkeypatch.setattr(blocks, "ITEMS", 60)
    seeds, alphas = asked(spark), (0.0, 0.5, 1.0)
    second = content.where("item_id % 3 <> 0") if narrow else content
    places = fusion.placed(content), fusion.placed(second)
    by_rows = [fusion.rank_list(R.written(R.rounded(s.join(i, "item_id", "left_semi"))), p) for s, i, p in ((M.similar(seeds, postings), content, places[0]), (M.dense_similar(M.dense_profiles(seeds, vectors), vectors), second, places[1]))]
    in_blocks = blocks.by_terms(seeds, postings, places[0]), blocks.by_vectors(seeds, vectors, places[1])
    show = lambda a, b: sorted(tuple(r) for r in R.top_k(fusion.fused_heads(a, b, seeds, 5, alphas, 2), 5, "alpha", "query_id").select("alpha", "query_id", "item_id", "score", "rank").collect())
    whole = show(*by_rows)
    assert show(*in_blocks) == whole
    assert show(in_blocks[0], by_rows[1]) == whole


def test_scored_pairs_are_not_written(spark, monkeypatch):
    """2,500 items and 40 queries score 100,000 pairs twice; the steps write the items, the heads and the pairs of those."""
    rng = random.Random(1)
    items = spark.range(2500).withColumnRenamed("id", "item_id").withColumns({"popularity": F.lit(0.5), "has_description": F.lit(True)})
    text = M.tfidf(items.select("item_id", F.concat_ws(" ", F.lit("alike"), F.concat(F.lit("x"), F.translate((F.col("item_id") % 50).cast("string"), "0123456789", "abcdefghij"))).alias("text")), 1, 1.0)
    vectors = R.written(spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(2500)], "item_id long, vector array<float>"))
    rows = []
    real = R.written
    count = lambda df: rows.append((out := real(df)).count()) or out
    for module in (R, M):
        monkeypatch.setattr(module, "written", count)
    seeds = spark.createDataFrame([(q, q * 3) for q in range(40)], "query_id long, item_id long")
    some = [m for m in models.standard(items, text, vectors) if m.name in ("tfidf", "embeddings", "hybrid")]
    top, _ = models.Lists(seeds, 1).every(some)
    assert top.count() == 3 * 40 * 10
    assert max(rows) < 20_000
