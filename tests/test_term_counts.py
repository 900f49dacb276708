"""Counts of terms within rows, and vocabularies small and large."""

from collections import Counter

import pytest

from tidemark.operators import similarity as M

ROWS = [(1, "red ring red bolt"), (2, "ring bolt plate"), (3, ""), (4, None), (5, "the of and"), (1, "bolt nut"), (6, "nut red Red RED"), (7, "plate x9 ring_2 ring")]


def test_counts_equal_those_of_python_and_need_no_shuffle_of_words(spark):
    counts = M.term_counts(spark.createDataFrame(ROWS[:5] + ROWS[6:], "item_id long, text string"))
    found = {(r["item_id"], r["term"]): r["tf"] for r in counts.collect()}
    assert found == Counter([(1, "red")] * 2 + [(1, "ring"), (1, "bolt"), (2, "ring"), (2, "bolt"), (2, "plate"), (6, "nut")] + [(6, "red")] * 3 + [(7, "plate"), (7, "ring")])
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_item_count_together(spark):
    found = {(r["item_id"], r["term"]): r["tf"] for r in M.term_counts(spark.createDataFrame(ROWS, "item_id long, text string")).collect()}
    assert found[1, "bolt"] == 2 and found[1, "nut"] == 1 and found[1, "red"] == 2


@pytest.mark.parametrize("small", [0, 200_000])
def test_weights_of_some_items_are_those_of_all(spark, monkeypatch, small):
    monkeypatch.setattr(M, "SMALL_VOCABULARY", small)
    items = spark.createDataFrame(ROWS, "item_id long, text string")
    every = {(r["item_id"], r["term"]): r["weight"] for r in M.tfidf(items).collect()}
    some = {(r["item_id"], r["term"]): r["weight"] for r in M.tfidf(items, of=spark.createDataFrame([(2,), (6,)], "item_id long")).collect()}
    assert some == {k: w for k, w in every.items() if k[0] in (2, 6)} and len(every) > len(some) > 0
