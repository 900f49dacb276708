"""Evaluations and hybrids make only what their models need, and read the interactions once."""

from tidemark.plans import evaluating, modelling
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_reader_models_need_no_texts_or_vectors(spark, monkeypatch):
    made = []
    monkeypatch.setattr(evaluating.M, "tfidf", lambda *a, **k: made.append("tfidf"))
    monkeypatch.setattr(evaluating.U, "embed", lambda *a, **k: made.append("embed"))
    assert QUERIES["mcnemar_counts"](spark, FOLDER).count() == 1
    assert made == []


def test_the_evaluation_makes_its_interactions_once(spark, monkeypatch):
    made, real = [], evaluating.interactions
    monkeypatch.setattr(evaluating, "interactions", lambda *a: made.append(a) or real(*a))
    monkeypatch.setattr(modelling, "interactions", lambda *a: made.append(a) or real(*a))
    assert QUERIES["mcnemar_counts"](spark, FOLDER).count() == 1
    assert len(made) == 1


def test_the_reranked_hybrid_reads_its_interactions_once_and_few_readers(spark, monkeypatch):
    made, real = [], modelling.interactions
    monkeypatch.setattr(modelling, "interactions", lambda *a: made.append(a) or real(*a))
    assert QUERIES["hybrid_popular_recommend"](spark, FOLDER).count() == 20
    assert len(made) == 1
    inter, seeds = modelling.R.written(real(spark, FOLDER)), modelling.seeds(spark)
    every, some = modelling.M.reader_postings(inter), modelling.M.reader_postings(inter, seeds)
    wanted = every.join(every.join(seeds, "item_id", "left_semi").select("term").distinct(), "term", "left_semi").select("item_id", "term", "weight")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, wanted.collect()))
    assert some.count() < every.count()
